"""Instrumented principal components y = Z Gamma F, by alternating least squares on month moments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.moments import Moments


@dataclass
class Model:
    """Gamma: L x K over characteristics; factors: K x T; the first `free` columns are latent, the others pre-specified."""

    gamma: np.ndarray
    factors: np.ndarray
    months: list
    iterations: int = 0
    free: int = 0
    moments: Moments | None = field(default=None, repr=False)

    def mean_loading(self) -> np.ndarray:
        return self.gamma @ self.factors.mean(axis=1)


def factor_step(gamma: np.ndarray, m: Moments, psf: np.ndarray | None = None) -> np.ndarray:
    """Latent factors of every month given Gamma (and the pre-specified factors' part)."""
    k = gamma.shape[1] - (0 if psf is None else len(psf))
    g, h = gamma[:, :k], gamma[:, k:]
    b = m.b if psf is None else m.b - np.einsum("tlm,mj,jt->tl", m.A, h, psf)
    left = np.einsum("lk,tlm,mj->tkj", g, m.A, g)
    right = np.einsum("lk,tl->tk", g, b)
    return np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(left, right, strict=True)], axis=1)


def gamma_step(factors: np.ndarray, m: Moments, alpha: float = 0.0, l1_ratio: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """Gamma given all factors: least squares (least norm where singular), ridge, or elastic net with intercept."""
    t, size, _ = m.A.shape
    k = len(factors)
    left = np.einsum("kt,jt,tlm->kljm", factors, factors, m.A).reshape(k * size, k * size)
    right = np.einsum("kt,tl->kl", factors, m.b).ravel()
    if alpha > 1e-8 and l1_ratio > 0:
        n = m.n.sum()
        sx, sy = np.einsum("kt,tl->kl", factors, m.sz).ravel(), m.sy.sum()
        q, c = left / n - np.outer(sx, sx) / n**2, right / n - sx * sy / n**2
        w = np.zeros(k * size) if start is None else start.T.ravel().copy()
        for _ in range(1000):
            old = w.copy()
            for j in range(len(w)):
                if q[j, j] <= 0:
                    continue
                rho = c[j] - q[j] @ w + q[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (q[j, j] + alpha * (1 - l1_ratio))
            if np.abs(w - old).max() < 1e-4 * max(np.abs(w).max(), 1e-12):
                break
        flat = w
    elif alpha > 1e-8:
        flat = np.linalg.solve(left + alpha * np.eye(len(left)), right)
    else:
        flat = np.linalg.lstsq(left, right, rcond=None)[0]
    return flat.reshape(k, size).T


def identify(gamma: np.ndarray, factors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gamma'Gamma = I and FF' diagonal for the latent part, with nonnegative mean factors; other columns made orthogonal to it."""
    if k == 0:
        return gamma, factors
    g, h, f, p = gamma[:, :k], gamma[:, k:], factors[:k], factors[k:]
    r1 = np.linalg.cholesky(g.T @ g + 1e-14 * np.eye(k)).T
    u, _, _ = np.linalg.svd(r1 @ f @ f.T @ r1.T)
    g, f = g @ np.linalg.inv(r1) @ u, u.T @ r1 @ f
    if h.shape[1]:
        over = g.T @ h
        h, f = h - g @ over, f + over @ p
    sign = np.where(f.mean(axis=1) >= 0, 1.0, -1.0)
    return np.hstack([g * sign, h]), np.vstack([f * sign[:, None], p])


def fit(m: Moments, n_factors: int = 1, max_iter: int = 10_000, tol: float = 1e-5, alpha: float = 0.0, l1_ratio: float = 0.0, psf: np.ndarray | None = None, warm: np.ndarray | None = None, warm_factors: np.ndarray | None = None) -> Model:
    """Alternating least squares to the largest change. Every month weighs as much as it has observations, of panels and of
    managed portfolios alike. warm: loadings to start from; warm_factors: what the first step's factors are compared with."""
    if n_factors > m.b.shape[1]:
        raise ValueError("more factors than characteristics")
    k = n_factors
    if warm is not None:
        gamma = warm
    else:
        q = (m.b / m.n[:, None]).T
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        gamma = u[:, :k] if u.shape[1] >= k else np.eye(len(u))[:, :k]
        if psf is not None:
            gamma = np.hstack([gamma, np.zeros((len(gamma), len(psf)))])
    factors, turn = warm_factors, 0
    while turn <= max_iter:
        latent = factor_step(gamma, m, psf) if k else np.zeros((0, len(m.n)))
        full = latent if psf is None else np.vstack([latent, psf])
        new, moved = identify(gamma_step(full, m, alpha, l1_ratio, gamma), full, k)
        change = np.abs(new - gamma).max()
        if psf is None and factors is not None:
            change = max(change, np.abs(moved - factors).max())
        gamma, factors, turn = new, moved, turn + 1
        if change < tol:
            break
    return Model(gamma, factors, list(m.months), turn, k, m)


def fit_rows(z: np.ndarray, y: np.ndarray, at: np.ndarray, months: list, n_factors: int, max_iter: int, tol: float, alpha: float, warm: np.ndarray | None = None) -> Model:
    """fit() with a ridge penalty from rows, for more characteristics than moments can hold: month number `at` of each row.

    With n rows and L characteristics the Gamma step solves n equations in the dual instead of L * K.
    """
    t, inner = len(months), z @ z.T
    rows = [np.flatnonzero(at == i) for i in range(t)]
    if warm is None:
        q = np.stack([z[r].T @ y[r] / len(r) for r in rows], axis=1)
        u, _, _ = np.linalg.svd(q, full_matrices=False)
        gamma = u[:, :n_factors] if u.shape[1] >= n_factors else np.eye(len(u))[:, :n_factors]
    else:
        gamma = warm
    factors, turn = None, 0
    while turn <= max_iter:
        seen = z @ gamma
        new_f = np.stack([np.linalg.lstsq(seen[r].T @ seen[r], seen[r].T @ y[r], rcond=None)[0] for r in rows], axis=1)
        weight = np.linalg.solve(inner * (new_f.T @ new_f)[np.ix_(at, at)] + max(alpha, 1e-10) * np.eye(len(y)), y)
        new, moved = identify(z.T @ (weight[:, None] * new_f.T[at]), new_f, n_factors)
        change = np.abs(new - gamma).max()
        if factors is not None:
            change = max(change, np.abs(moved - factors).max())
        gamma, factors, turn = new, moved, turn + 1
        if change < tol:
            break
    return Model(gamma, factors, list(months), turn, n_factors)


def dot(chars: list[str], weights: np.ndarray) -> Column:
    """Sum of characteristics by weights, a plain expression."""
    total = F.lit(0.0)
    for c, w in zip(chars, np.asarray(weights, dtype=float), strict=True):
        total = total + F.col(c) * F.lit(float(w))
    return total


def predict(df: DataFrame, chars: list[str], model: Model, mean_factor: bool = True, month: str = "month", name: str = "y_pred") -> DataFrame:
    """df with predictions: Z Gamma times the mean factor, or times the month's own; months not fitted are an error then."""
    if mean_factor:
        return df.withColumn(name, dot(chars, model.mean_loading()))
    if unseen := [r[0] for r in df.select(month).distinct().collect() if r[0] not in set(model.months)]:  # a row per month
        raise ValueError(f"months without factors: {unseen[:5]}")
    rows = [(t, [float(v) for v in model.gamma @ model.factors[:, i]]) for i, t in enumerate(model.months)]
    loadings = F.broadcast(df.sparkSession.createDataFrame(rows, "__t date, __g array<double>"))  # a row per month
    total = F.aggregate(F.zip_with(F.array(*chars), "__g", lambda x, g: x * g), F.lit(0.0), lambda s, v: s + v)
    return df.join(loadings, df[month] == F.col("__t"), "left").withColumn(name, total).drop("__t", "__g")


def score(m: Moments, model: Model, mean_factor: bool = False) -> float:
    """R2 of the panel from its moments."""
    f = np.repeat(model.factors.mean(axis=1, keepdims=True), len(m.n), axis=1) if mean_factor else model.factors
    w = np.einsum("lk,kt->tl", model.gamma, f)
    res = (m.yy - 2 * (w * m.b).sum(axis=1) + np.einsum("tl,tlm,tm->t", w, m.A, w)).sum()
    return float(1 - res / m.yy.sum())


def predict_oos(m: Moments, model: Model) -> np.ndarray:
    """Gamma times each new month's own realised factor."""
    return np.einsum("lk,kt->tl", model.gamma, factor_step(model.gamma, m))


def fit_path(folds: dict[int, Moments], alphas: list[float], **options) -> list[tuple[float, float]]:
    """(alpha, mean squared error) by cross-validation: moments per fold and month; training moments are total minus fold."""
    out = []
    for a in alphas:
        res, n = 0.0, 0.0
        for k in folds:
            others = [folds[j] for j in folds if j != k]
            months = sorted({t for x in others for t in x.months})
            at = {t: i for i, t in enumerate(months)}
            size = others[0].b.shape[1]
            total = Moments(months, np.zeros((len(months), size, size)), np.zeros((len(months), size)), *(np.zeros(len(months)) for _ in range(2)), np.zeros((len(months), size)), np.zeros(len(months)))
            for x in others:
                rows = [at[t] for t in x.months]
                for name in ("A", "b", "yy", "n", "sz", "sy"):
                    np.add.at(getattr(total, name), rows, getattr(x, name))
            model = fit(total, alpha=a, **options)
            w = model.mean_loading()
            x = folds[k]
            res += (x.yy - 2 * x.b @ w + np.einsum("l,tlm,m->t", w, x.A, w)).sum()
            n += x.n.sum()
        out.append((a, float(res / n)))
    return out


def bootstrap(spark: SparkSession, model: Model, columns: list[int] | None = None, row: int | None = None, draws: int = 1000, tasks: int = 32, **options) -> tuple[float, float, DataFrame]:
    """Wild bootstrap of the hypothesis that Gamma's columns (or one row) are zero: statistic, p-value, and the draws.

    Residuals of managed portfolios, drawn by month and scaled by Student-t(5), are added to the fit under the hypothesis;
    each draw refits in a task, seeded by its number. The p-value is the share of draws above the statistic.
    """
    m = model.moments
    zero = np.ones_like(model.gamma, dtype=bool)
    if row is not None:
        zero[row] = False
    else:
        zero[:, columns or [model.gamma.shape[1] - 1]] = False
    tested = model.gamma[~zero]
    statistic = float((tested**2).sum())
    null = model.gamma * zero
    fitted = np.einsum("tlm,mk,kt->tl", m.A, null, model.factors)
    resid = (m.b - np.einsum("tlm,mk,kt->tl", m.A, model.gamma, model.factors)) / m.n[:, None]
    free, t = model.free, len(m.n)
    psf = model.factors[free:] if model.factors.shape[0] > free else None
    keep = (m.months, m.A, m.yy, m.n, m.sz, m.sy)
    gamma = model.gamma
    scale = 1 / np.sqrt(5 / 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch["id"]:
                rng = np.random.default_rng(int(d))
                b = fitted + resid[rng.integers(0, t, t)] * (rng.standard_t(5, t) * scale)[:, None] * keep[3][:, None]
                again = fit(Moments(keep[0], keep[1], b, *keep[2:]), free, psf=psf, warm=gamma, **options)
                rows.append((int(d), float((again.gamma[~zero] ** 2).sum())))
            yield pd.DataFrame(rows, columns=["draw", "statistic"])

    found = spark.range(0, draws, 1, min(tasks, draws)).mapInPandas(run, "draw long, statistic double")
    p = found.agg(F.avg((F.col("statistic") > statistic).cast("double"))).first()[0]
    return statistic, float(p), found


def _may_bootstrap(model: Model, alpha: float) -> None:
    if alpha > 0:
        raise ValueError("a regularised fit can't be bootstrapped")
    if model.moments is None:
        raise ValueError("the model has no moments")


def test_alpha(spark: SparkSession, model: Model, alpha: float = 0.0, **options) -> tuple[float, float, DataFrame]:
    """Bootstrap test that the intercept's loadings are zero; the intercept is the last pre-specified factor, of ones."""
    _may_bootstrap(model, alpha)
    if model.factors.shape[0] == model.free or not np.allclose(model.factors[-1], 1.0):
        raise ValueError("the model was fitted without an intercept")
    return bootstrap(spark, model, [model.gamma.shape[1] - 1], **options)


def test_characteristic(spark: SparkSession, model: Model, row: int, alpha: float = 0.0, **options) -> tuple[float, float, DataFrame]:
    """Bootstrap test that one characteristic has no loading on any latent factor."""
    _may_bootstrap(model, alpha)
    if model.factors.shape[0] > model.free:
        raise ValueError("the model has pre-specified factors")
    return bootstrap(spark, model, row=row, **options)


def test_delta(spark: SparkSession, model: Model, alpha: float = 0.0, **options) -> tuple[float, float, DataFrame]:
    """Bootstrap test that the loadings of the one pre-specified factor are zero."""
    _may_bootstrap(model, alpha)
    if model.factors.shape[0] != model.free + 1 or np.allclose(model.factors[-1], 1.0):
        raise ValueError("the model needs one pre-specified factor and no intercept")
    return bootstrap(spark, model, [model.gamma.shape[1] - 1], **options)
