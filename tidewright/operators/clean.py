"""Panel cleaning: sparse columns, missing values, collinear columns, model panels, normalisation and merges."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.schema import assert_unique, nan_to_null, numeric_columns, require_columns


def null_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row, the share of NULLs per column, in one pass."""
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns or df.columns))


def drop_sparse_columns(df: DataFrame, most: float = 0.6, protected: tuple[str, ...] = ()) -> DataFrame:
    """df without columns whose share of NULLs is over `most`."""
    if not 0 <= most <= 1:
        raise ValueError("a share lies between 0 and 1")
    columns = [c for c in df.columns if c not in protected]
    shares = null_shares(df, columns).first().asDict() if columns else {}
    return df.drop(*(c for c in columns if (shares[c] or 0) > most))


def exact_percentiles(df: DataFrame, asked: dict[str, list[float]], accuracy: int = 100_000) -> dict[str, list[float | None]]:
    """Exact interpolated percentiles of whole columns, in two passes of bounded aggregates.

    A sketch of `accuracy` brackets each rank within about 2 / accuracy of the rows; the second pass counts what lies below
    the bracket and gathers only the distinct values inside it with their counts. Values that are sums in no fixed order may
    differ by last bits between the passes: brackets are wider by `slack` of their ends.
    """
    edge, slack = 2.0 / accuracy, 1e-9
    around = lambda q: F.array(*(F.lit(min(max(x, 0.0), 1.0)) for x in (q - edge, q + edge)))
    wider = lambda end, by: end + by * abs(end) if math.isfinite(end) else end
    keys = [(c, q) for c, qs in asked.items() for q in qs]
    known = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    first = df.agg(*(F.count(known(c)).alias(f"n_{i}") for i, (c, _) in enumerate(keys)), *(F.percentile_approx(known(c), around(q), accuracy).alias(f"e_{i}") for i, (c, q) in enumerate(keys))).first()
    used = [i for i in range(len(keys)) if first[f"n_{i}"]]
    found: dict[int, float | None] = dict.fromkeys(range(len(keys)))
    if used:
        # values below a bracket are one group, those inside one each, those above left out
        each = F.array(*(F.struct(F.lit(i).alias("i"), known(keys[i][0]).alias("v"), F.lit(wider(first[f"e_{i}"][0], -slack)).alias("lo"), F.lit(wider(first[f"e_{i}"][1], slack)).alias("hi")) for i in used))
        rows = df.select(F.explode(each).alias("x")).select("x.*").filter("v <= hi").groupBy("i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).count().collect()
        for i in used:
            rank = (first[f"n_{i}"] - 1) * keys[i][1]
            at, seen, values = int(rank), 0, []
            for v, n in sorted(((r["v"], r["count"]) for r in rows if r["i"] == i), key=lambda x: (x[0] is not None, x[0])):
                seen += n
                while v is not None and len(values) < 2 and seen > at + len(values):
                    values.append(v)
            found[i] = values[0] + (rank - at) * (values[1] - values[0]) if len(values) > 1 and rank > at else values[0]
    out: dict[str, list[float | None]] = {c: [] for c in asked}
    for i, (c, _) in enumerate(keys):
        out[c].append(found[i])
    return out


def fill_missing(df: DataFrame, columns: list[str], month: str = "month", past_only: bool = False) -> DataFrame:
    """NULLs become the month's median; what is left, the median of all rows (taken before the first step), or with
    past_only the median of the months' medians strictly before.
    """
    require_columns(df, [month, *columns])
    medians = df.groupBy(month).agg(*(F.median(c).alias(f"__m_{c}") for c in columns))
    if past_only:
        # one row per month: a window without partition stays small
        before = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
        medians = medians.withColumns({f"__g_{c}": F.percentile(f"__m_{c}", F.lit(0.5)).over(before) for c in columns})
        rows = df.join(medians, month, "left")
    else:
        whole = exact_percentiles(df, {c: [0.5] for c in columns})
        rows = df.join(medians, month, "left").withColumns({f"__g_{c}": F.lit(whole[c][0]).cast("double") for c in columns})
    return rows.select(*(F.coalesce(c, f"__m_{c}", f"__g_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, corr) of all pairs, rows with both present, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    stack = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {stack}) as (x, y, corr)")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    stack = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {stack}) as (x, y, cov)")


def drop_flat_and_collinear(df: DataFrame, columns: list[str], min_std: float = 1e-6, max_corr: float = 0.98) -> list[str]:
    """The columns that stay: those of some spread, and of each pair over max_corr the one with fewer NULLs, or else the
    lower mean absolute correlation. Two aggregate rows of at most len(columns)^2 numbers reach the driver.
    """
    stats = df.agg(*(F.stddev_pop(c).alias(f"s_{c}") for c in columns), *(F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}") for c in columns)).first()
    kept = [c for c in columns if stats[f"s_{c}"] is not None and stats[f"s_{c}"] > min_std]
    if len(kept) < 2:
        return kept
    found = {(r["x"], r["y"]): abs(r["corr"]) if r["corr"] is not None else 0.0 for r in correlations(df, kept).collect()}
    found |= {(y, x): v for (x, y), v in found.items()}
    mean = {c: (1 + sum(found[c, o] for o in kept if o != c)) / len(kept) for c in kept}
    gone: set[str] = set()
    for a, b in combinations(kept, 2):
        if a in gone or b in gone or found[a, b] <= max_corr:
            continue
        na, nb = stats[f"n_{a}"], stats[f"n_{b}"]
        gone.add((a if na > nb else b) if na != nb else (a if mean[a] >= mean[b] else b))
    return [c for c in kept if c not in gone]


def factor_relevance(df: DataFrame, factors: list[str], target: str, least: int = 24) -> DataFrame:
    """(factor, strength, n): |corr| with the target over at least `least` common rows; with an unusable target, coverage."""
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    one = df.agg(*(F.corr(c, target).alias(f"c_{c}") for c in factors), *(F.sum(both(c).cast("long")).alias(f"n_{c}") for c in factors), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"v_{c}") for c in factors))
    stack = ", ".join(f"'{c}', abs(c_{c}), n_{c}, v_{c}" for c in factors)
    rows = one.selectExpr(f"stack({len(factors)}, {stack}) as (factor, corr, n, coverage)")
    rows = rows.withColumn("strength", F.when(F.col("n") >= least, F.col("corr")))
    usable = rows.agg(F.count("strength").alias("usable"))
    return rows.crossJoin(F.broadcast(usable)).select("factor", F.when(F.col("usable") > 0, F.coalesce("strength", F.lit(0.0))).otherwise(F.col("coverage")).alias("strength"), "n")


def compact_subset(df: DataFrame, factors: list[str], target: str, n_factors: int = 10, n_ids: int = 20, n_years: int = 10, month: str = "month", id: str = "permno") -> DataFrame:
    """The last n_years, of them the n_ids with most rows, and the n_factors closest to the target."""
    last = F.broadcast(df.agg(F.max(F.year(month)).alias("__last")))
    recent = df.crossJoin(last).filter(F.year(month) > F.col("__last") - n_years).drop("__last")
    top = recent.groupBy(id).count().orderBy(F.desc("count"), id).limit(n_ids).select(id)
    rows = recent.join(F.broadcast(top), id, "left_semi")  # n_ids rows
    best = [r["factor"] for r in factor_relevance(rows, factors, target).orderBy(F.desc("strength"), "factor").limit(n_factors).collect()]
    return rows.select(id, month, target, *sorted(best))


def packed_rows(df: DataFrame, columns: list[str], target: str | None = None, name: str = "x", mask: str = "finite") -> DataFrame:
    """df with its columns as one array and whether all of a row's numbers (and its target) are there and finite."""
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    whole = F.lit(True)
    for c in [*columns, *([target] if target else [])]:
        whole = whole & there(c)
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns))).withColumn(mask, whole)


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with sorted dense codes of a column: the window runs over distinct keys only."""
    keys = df.select(column).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(column)).cast("long") - 1)
    return df.join(keys, column, "left")


def model_panel(df: DataFrame, ret: str, id: str = "permno", month: str = "month", shift_target: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows with target y (the entity's next row's return, or the same row's), characteristics, and dense codes i_idx, t_idx."""
    after = Window.partitionBy(id).orderBy(month)
    rows = nan_to_null(df).withColumn("y", F.lead(ret).over(after) if shift_target else F.col(ret))
    chars = numeric_columns(df, (id, month, ret, "y", *exclude))
    rows = rows.dropna(subset=[id, month, "y"]).select(id, month, "y", *chars)
    return dense_codes(dense_codes(rows, id, "i_idx"), month, "t_idx")


def split(df: DataFrame, cutoff, month: str = "month") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(month) <= F.lit(cutoff).cast("date")), df.filter(F.col(month) > F.lit(cutoff).cast("date"))


def normalise(train: DataFrame, test: DataFrame, columns: list[str], clip: tuple[float, float] | None = (1, 99)) -> tuple[DataFrame, DataFrame]:
    """Both by the training mean and standard deviation (0 or NULL counts as 1), clipped to training quantiles.

    The statistics are taken once, as numbers: partial sums that merge in another order give other last bits, and values
    scaled by those would miss their own brackets.
    """
    stats = train.agg(*(F.avg(c).alias(f"mu_{c}") for c in columns), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"sd_{c}") for c in columns)).first() if columns else {}

    def scaled(df: DataFrame) -> DataFrame:
        number = lambda name: F.lit(stats[name]).cast("double")
        return df.select(*(((F.col(c) - number(f"mu_{c}")) / number(f"sd_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))

    a, b = scaled(train), scaled(test)
    if clip is None:
        return a, b
    bounds = exact_percentiles(a, {c: [q / 100 for q in clip] for c in columns})

    def clipped(df: DataFrame) -> DataFrame:
        def keep(c: str):
            lo, hi = (F.lit(v).cast("double") for v in bounds[c])
            return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo), hi)).alias(c)

        return df.select(*(keep(c) if c in columns else F.col(c) for c in df.columns))

    return clipped(a), clipped(b)


def merge_returns(panel: DataFrame, returns: DataFrame, how: str = "inner", id: str = "permno", month: str = "month", ret: str = "ret_adj", out: str = "ret", market_cap: bool = True) -> DataFrame:
    """m:1 merge on id and month; clashing columns of the panel give way; mcap = |prc| * shrout."""
    right = returns.withColumn(month, F.trunc(month, "MM"))
    if market_cap:
        right = right.withColumn("mcap", F.abs("prc") * F.col("shrout"))
    right = assert_unique(right.select(id, month, F.col(ret).alias(out), *(["mcap"] if market_cap else [])), [id, month])
    left = panel.withColumn(month, F.trunc(month, "MM")).drop(out, *(["mcap"] if market_cap else []))
    return left.join(right, [id, month], how)


def compound(ret: str, extra: str):
    """(1 + ret)(1 + extra) - 1 with a missing one as 0, NULL where both are missing."""
    both = (1 + F.coalesce(ret, F.lit(0.0))) * (1 + F.coalesce(extra, F.lit(0.0))) - 1
    return F.when(F.col(ret).isNotNull() | F.col(extra).isNotNull(), both)


def members(rows: DataFrame, spells: DataFrame, id: str = "permno", date: str = "month") -> DataFrame:
    """Rows inside one of their entity's spells [start, ending], ending NULL: still open."""
    s = spells.withColumnRenamed(id, "__id")
    inside = (rows[id] == s["__id"]) & (rows[date] >= s["start"]) & (s["ending"].isNull() | (rows[date] <= s["ending"]))
    return rows.join(s, inside).select(*(rows[c] for c in rows.columns), "start", "ending")
