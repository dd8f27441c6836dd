"""Rolling monthly refits of factor models: each test month is predicted from earlier months only."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import subspace
from tidewright.functions.rff import expand, frequencies
from tidewright.operators import grassmann, ipca
from tidewright.operators.moments import Moments, collect, month_moments, packed
from tidewright.schema import assert_unique, nan_to_null


def training_windows(df: DataFrame, months: int, month: str = "month") -> DataFrame:
    """(test_month, month) pairs with test - months <= month < test, over the months that occur."""
    seen = df.select(month).distinct()
    tests = seen.withColumnRenamed(month, "test_month")
    near = (F.col(month) >= F.add_months("test_month", -months)) & (F.col(month) < F.col("test_month"))
    return tests.join(F.broadcast(seen), near)  # a row per month


def universe_moments(panel: DataFrame, chars: list[str], target: str, chosen: DataFrame, months: int, month: str = "month", id: str = "permno") -> DataFrame:
    """Moments of each test month's training window over that month's universe only: (test_month, month, n, ...).

    chosen: (month, id) of the universes, of a few names a month; the window's rows are found by id and month.
    """
    near = training_windows(panel, months, month).join(chosen.withColumnRenamed(month, "test_month"), "test_month")
    return month_moments(near.join(panel, [month, id]), chars, target, month, by=("test_month",))


def align_warm_factors(old: np.ndarray, old_months: list, months: list) -> np.ndarray | None:
    """Factors of earlier months where known, the mean of those elsewhere; None where no month is known."""
    at = {t: i for i, t in enumerate(old_months)}
    known = [t in at for t in months]
    if not any(known):
        return None
    found = np.stack([old[:, at[t]] if k else np.zeros(len(old)) for t, k in zip(months, known, strict=True)], axis=1)
    found[:, ~np.array(known)] = found[:, np.array(known)].mean(axis=1, keepdims=True)
    return found


def normalised(m: Moments, mu: np.ndarray, sd: np.ndarray) -> Moments:
    """Moments of (z - mu) / sd from those of z; no second pass over the rows."""
    a = m.A - mu[None, :, None] * m.sz[:, None, :] - m.sz[:, :, None] * mu[None, None, :] + m.n[:, None, None] * np.outer(mu, mu)
    a = a / np.outer(sd, sd)
    b = (m.b - mu * m.sy[:, None]) / sd
    return Moments(m.months, a, b, m.yy, m.n, (m.sz - m.n[:, None] * mu) / sd, m.sy)


def statistics(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    n = m.n.sum()
    mu = m.sz.sum(axis=0) / n
    sd = np.sqrt(np.maximum(np.einsum("tll->l", m.A) / n - mu**2, 0))
    return mu, np.where(sd > 0, sd, 1.0)


DIAGNOSTICS = "erank grassmann_dist d_proj principal_angle_max principal_angle_mean geodesic_acceleration gap_ratio d_proj_norm".split()


def diagnostics(fits: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[str, float]]:
    """DIAGNOSTICS of a sequence of (gamma, factors): each fit's factor covariance, and its subspace against the fit before.

    Acceleration is the change of the projection distance. Values without a predecessor, or that aren't finite, are left out.
    """
    rows: list[dict[str, float]] = []
    for i, (gamma, f) in enumerate(fits):
        _, rank, gap = subspace.factor_covariance(f)
        row = {"erank": rank, "gap_ratio": gap}
        if i and fits[i - 1][0].shape == gamma.shape:
            old = fits[i - 1][0]
            angles = subspace.principal_angles(gamma, old)
            d = subspace.distance(gamma, old, "projection")
            row |= {"grassmann_dist": subspace.distance(gamma, old), "d_proj": d, "principal_angle_max": angles.max(), "principal_angle_mean": angles.mean()}
            row["d_proj_norm"] = d / subspace.random_baseline(*gamma.shape)
            if "d_proj" in rows[-1]:
                row["geodesic_acceleration"] = d - rows[-1]["d_proj"]
        rows.append({k: float(v) for k, v in row.items() if np.isfinite(v)})
    return rows


def _fit(part: Moments, estimator: str, k: int, alpha: float, max_iter: int, tol: float, intercept: bool, warm) -> ipca.Model:
    gamma, f = (None, None) if warm is None else warm
    if estimator == "als":
        psf = np.ones((1, len(part.n))) if intercept else None
        return ipca.fit(part, k, max_iter, tol, alpha, psf=psf, warm=gamma, warm_factors=f)
    return grassmann.fit(part, k, max(alpha, 1e-8), max_iter, tol, warm=gamma)


def rolling_factors(
    panel: DataFrame, chars: list[str], target: str = "y", forecast_start=None, n_factors: int = 3, window: int | None = None, min_obs: int = 5000,
    estimator: str = "als", alpha: float = 1.0, max_iter: int = 5000, tol: float = 1e-4, normalize: str | None = None, warm_start: bool = True, intercept: bool = False,
    universe: DataFrame | None = None, rff: dict | None = None, month: str = "month", id: str = "permno",
) -> tuple[DataFrame, DataFrame]:
    """(predictions, diagnostics): every month from forecast_start on is predicted from the months before it.

    estimator: als or grassmann. window: months of training, None for all. normalize: None, rolling (each window's own mean
    and deviation), or frozen (those of the first window). universe: (month, id) that a test month and its training rows
    are restricted to, as previous_month() gives it. rff: options of random features (n, gamma, seed or omega, and
    normalize where it differs), which take the place of the characteristics. Months whose training rows are fewer than
    min_obs, or whose universe is empty, are left out. Rows without all characteristics get NULL predictions.

    Without random features the panel is aggregated to month moments once (per test month, with a universe); windows are
    sums of them, and predictions are one join of the months' loadings to the panel. Refits run on the driver one after
    the other where each starts from the one before, and in tasks where they don't. With random features see _by_rows().
    """
    if estimator not in ("als", "grassmann") or normalize not in (None, "rolling", "frozen"):
        raise ValueError("estimator als or grassmann; normalize None, rolling or frozen")
    spark = panel.sparkSession
    panel = nan_to_null(panel, [*chars, target])
    months = [r[0] for r in panel.select(month).filter(F.col(month).isNotNull()).distinct().orderBy(month).collect()]  # a row per month
    start = forecast_start or (months[min(12, len(months) - 1)] if months else None)
    tests = [t for i, t in enumerate(months) if i and t >= start]
    if rff is not None:
        return _by_rows(panel, chars, target, tests, n_factors, window, min_obs, estimator, alpha, max_iter, tol, normalize, warm_start, universe, rff, month, id)
    assert_unique(panel.select(id, month), [id, month])
    if universe is None:
        m = collect(month_moments(panel, chars, target, month), len(chars), month)
        age = lambda test: np.array([(test.year - t.year) * 12 + test.month - t.month for t in m.months])
        parts = {t: m.part((age(t) > 0) & ((age(t) <= window) if window else True)) for t in tests}
        counts = {r[0]: r[1] for r in panel.groupBy(month).count().collect()}
    else:
        reach = window or 12 * (months[-1].year - months[0].year + 1) if months else 1
        rows: dict = {t: [] for t in tests}
        for r in universe_moments(panel, chars, target, universe, reach, month, id).collect():  # a row per test and training month
            if r["test_month"] in rows:
                rows[r["test_month"]].append(r)
        parts = {t: packed(x, len(chars), month) for t, x in rows.items()}
        panel = panel.join(universe.select(month, id), [month, id], "left_semi")
        counts = {r[0]: r[1] for r in panel.groupBy(month).count().collect()}
    used = [t for t in tests if len(parts[t].n) and parts[t].n.sum() >= min_obs and counts.get(t)]
    scaled, stats, frozen = {}, {}, None
    for t in used:
        mu, sd = np.zeros(len(chars)), np.ones(len(chars))
        if normalize:
            mu, sd = statistics(parts[t]) if normalize == "rolling" or frozen is None else frozen
            frozen = frozen or (mu, sd)
        scaled[t], stats[t] = normalised(parts[t], mu, sd) if normalize else parts[t], (mu, sd)
    options = (estimator, n_factors, alpha, max_iter, tol, intercept)
    if warm_start:
        models, last = [], None
        for t in used:
            warm = None if last is None else (last.gamma, align_warm_factors(last.factors, last.months, scaled[t].months))
            last = _fit(scaled[t], *options, warm)
            models.append(last)
    else:
        models = _refits(spark, [scaled[t] for t in used], options)
    loadings = []
    for t, model in zip(used, models, strict=True):
        mu, sd = stats[t]
        w = model.mean_loading() / sd
        loadings.append((t, int(parts[t].n.sum()), [float(v) for v in w], float(-(w @ mu))))
    at = F.broadcast(spark.createDataFrame(loadings, "__t date, n_train long, g array<double>, shift double"))  # a row per month
    total = F.aggregate(F.zip_with(F.array(*(F.col(c).cast("double") for c in chars)), "g", lambda x, g: x * g), F.lit(0.0), lambda s, v: s + v)
    rows = panel.join(at, F.col(month) == F.col("__t"))
    pred = rows.select(id, month, F.col(target).alias("y_true"), (total + F.col("shift")).alias("y_pred"), F.add_months(month, -1).alias("train_end"), "n_train")
    notes = diagnostics([(x.gamma, x.factors) for x in models])
    return pred, _notes(spark, [(t, *(r.get(c) for c in DIAGNOSTICS), int(parts[t].n.sum()), counts[t]) for t, r in zip(used, notes, strict=True)])


def _refits(spark, parts: list[Moments], options: tuple) -> list[ipca.Model]:
    """A fit per task, where none starts from another; its moments travel as one row, L x K and K x T numbers come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, raw in zip(batch["i"], batch["raw"], strict=True):
                part = pickle.loads(raw)
                model = _fit(part, *options, None)
                yield pd.DataFrame({"i": [i], "gamma": [model.gamma.ravel()], "factors": [model.factors.ravel()], "turns": [model.iterations]})

    if not parts:
        return []
    jobs = spark.createDataFrame([(i, bytearray(pickle.dumps(p))) for i, p in enumerate(parts)], "i long, raw binary").repartition(len(parts), "i")
    found = sorted(jobs.mapInPandas(run, "i long, gamma array<double>, factors array<double>, turns int").collect(), key=lambda r: r["i"])
    k = options[1] + options[-1]  # with the intercept
    return [ipca.Model(np.array(r["gamma"]).reshape(-1, k), np.array(r["factors"]).reshape(k, -1), p.months, r["turns"], options[1], p) for r, p in zip(found, parts, strict=True)]


def _notes(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "month date, " + ", ".join(f"{c} double" for c in DIAGNOSTICS) + ", n_train long, n_test long")


def _by_rows(panel, chars, target, tests, n_factors, window, min_obs, estimator, alpha, max_iter, tol, normalize, warm_start, universe, options, month, id) -> tuple[DataFrame, DataFrame]:
    """Rolling refits on random features: each test month's training rows go to a task, which expands and fits them.

    A window must be bounded by `window` months or a universe; its rows, not their moments, are what fits into a task
    (with thousands of features there are fewer rows than features, and the dual is solved). Where each refit starts from
    the one before, all run in one task in turn.
    """
    if window is None and universe is None:
        raise ValueError("random features need a window or a universe")
    spark, scale = panel.sparkSession, options.get("normalize", normalize)
    omega = options.get("omega")
    omega = frequencies(len(chars), options.get("n", 500), options.get("gamma", 2.0), options.get("seed", 42)) if omega is None else np.asarray(omega, dtype=float)
    if omega.ndim != 2 or len(omega) != len(chars):
        raise ValueError("omega needs a row per characteristic")
    rows = panel.select(F.col(month).alias("month"), F.col(id).alias("id"), F.col(target).cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in chars)).alias("x"))
    span = window or 12_000
    each = spark.createDataFrame([(t,) for t in tests], "test date")
    near = F.broadcast(each) if universe is None else each.join(universe.select(F.col(month).alias("test"), F.col(id).alias("id")), "test")
    within = (rows["month"] <= near["test"]) & (rows["month"] >= F.add_months(near["test"], -span))
    dealt = rows.join(near, within if universe is None else within & (rows["id"] == near["id"]))
    dealt = dealt.select(near["test"], rows["month"], rows["id"], "y", "x").withColumn("turn", F.lit(0) if warm_start else F.col("test"))
    base = None
    if scale == "frozen" and tests:
        first = dealt.filter((F.col("test") == F.lit(tests[0])) & (F.col("month") < F.col("test")) & F.forall("x", lambda v: v.isNotNull()))
        mean = first.agg(*(f(F.col("x")[i]) for i in range(len(chars)) for f in (F.avg, F.stddev_pop))).first()
        if mean[0] is None:
            raise ValueError("the first window has no complete row")
        base = np.array(mean[::2], dtype=float), np.array([v if v else 1.0 for v in mean[1::2]], dtype=float)

    def run(held: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for test, part in sorted(held.groupby("test"), key=lambda x: x[0]):
            x = np.stack(part["x"].to_numpy()).astype(float)
            y, when = part["y"].to_numpy(dtype=float), part["month"].to_numpy()
            whole = np.isfinite(x).all(axis=1)
            train, ask = whole & np.isfinite(y) & (when < test), when == test
            if train.sum() < max(min_obs, 1) or not ask.any():
                continue
            mu, sd = base if base is not None else (x[train].mean(axis=0), x[train].std(axis=0)) if scale == "rolling" else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
            z = expand((x - mu) / np.where(sd > 0, sd, 1.0), omega)
            months, at = np.unique(when[train], return_inverse=True)
            warm = None if last is None or not warm_start else last.gamma
            if estimator == "als" and train.sum() < n_factors * z.shape[1]:
                last = ipca.fit_rows(z[train], y[train], at, list(months), n_factors, max_iter, tol, alpha, warm)
            else:
                up = [np.flatnonzero(train)[at == i] for i in range(len(months))]
                m = Moments(list(months), np.stack([z[r].T @ z[r] for r in up]), np.stack([z[r].T @ y[r] for r in up]), np.array([(y[r] ** 2).sum() for r in up]), np.array([float(len(r)) for r in up]), np.stack([z[r].sum(axis=0) for r in up]), np.array([y[r].sum() for r in up]))
                last = _fit(m, estimator, n_factors, alpha, max_iter, tol, False, None if warm is None else (warm, None))
            pred = np.where(whole[ask], np.nan_to_num(z[ask]) @ last.mean_loading(), np.nan)
            flat = pd.DataFrame({"test": test, "id": part["id"].to_numpy()[ask], "y_true": y[ask], "y_pred": pred, "n_train": int(train.sum()), "gamma": None, "factors": None})
            note = pd.DataFrame({"test": [test], "id": [None], "y_true": [np.nan], "y_pred": [np.nan], "n_train": [int(train.sum())], "gamma": [last.gamma.ravel()], "factors": [last.factors.ravel()]})
            out += [flat, note]
        return pd.concat(out) if out else pd.DataFrame(columns=["test", "id", "y_true", "y_pred", "n_train", "gamma", "factors"])

    kind = rows.schema["id"].dataType.simpleString()
    found = dealt.groupBy("turn").applyInPandas(run, f"test date, id {kind}, y_true double, y_pred double, n_train long, gamma array<double>, factors array<double>").persist()
    pred = nan_to_null(found.filter("gamma is null"), ["y_true", "y_pred"])
    counts = {r["test"]: r["count"] for r in pred.groupBy("test").count().collect()}
    fits = sorted(found.filter("gamma is not null").select("test", "n_train", "gamma", "factors").collect(), key=lambda r: r["test"])  # L x K numbers a month
    notes = diagnostics([(np.array(r["gamma"]).reshape(-1, n_factors), np.array(r["factors"]).reshape(n_factors, -1)) for r in fits])
    pred = pred.select(
        F.col("id").alias(id), F.col("test").alias(month), "y_true", "y_pred", F.add_months("test", -1).alias("train_end"), "n_train",
        F.lit(omega.shape[1]).alias("rff_n_components"), F.lit(float(options.get("gamma", 2.0))).alias("rff_gamma"),
    )
    return pred, _notes(spark, [(r["test"], *(x.get(c) for c in DIAGNOSTICS), r["n_train"], counts[r["test"]]) for r, x in zip(fits, notes, strict=True)])
