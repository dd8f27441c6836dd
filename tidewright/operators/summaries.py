"""Tables behind profiles and plots: describe, histogram, box, density, and a bootstrap interval of a mean."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, sd, lo, q1, q2, q3, hi) of the values that are there, a row per group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), q.alias("q"), F.max(column).alias("hi"))
    return g.select(*(by or []), "n", "mean", "sd", "lo", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)), "hi")


def mean_profile(df: DataFrame, column: str, by: list[str], over: str) -> DataFrame:
    """describe() for each value of `over` (a seed, say), its numbers averaged over them."""
    each = describe(df, column, [*by, over])
    return each.groupBy(*by).agg(*(F.avg(c).alias(c) for c in each.columns if c not in (*by, over)))


def _ends(df: DataFrame, column: str) -> DataFrame:
    return F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))  # one row


def histogram(df: DataFrame, column: str, bins: int = 3) -> DataFrame:
    """(bin, n, lo, hi): equal-width bins over the values' range, numbered from 1; lo and hi are of the bin's own values."""
    rows = df.filter(F.col(column).isNotNull()).select(column)
    share = F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    spot = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int") + 1
    return rows.crossJoin(_ends(rows, column)).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))


def box(df: DataFrame, column: str, by: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """(by, q1, q2, q3, low, high, n_out): quartiles, the outermost values within `whisker` quartile ranges, and how many lie beyond."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*(by or [])).agg(q.alias("q"))
    x, spread = F.col(column), (F.col("q")[2] - F.col("q")[0]) * whisker
    inside = (x >= F.col("q")[0] - spread) & (x <= F.col("q")[2] + spread)
    rows = df.join(F.broadcast(g), by) if by else df.crossJoin(F.broadcast(g))  # a row per group of a plot
    return rows.filter(x.isNotNull()).groupBy(*(by or [])).agg(
        *(F.first(F.col("q")[i]).alias(f"q{i + 1}") for i in range(3)), F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"),
        F.sum((~inside).cast("long")).alias("n_out"),
    )


def density(df: DataFrame, column: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at `points` places from one bandwidth below to one above the range; by
    default the bandwidth is n^(-1/5) standard deviations. One pass, a sum per place."""
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("__v"))
    s = F.broadcast(rows.agg(F.count("*").alias("n"), F.stddev_samp("__v").alias("sd"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))  # one row
    h = F.lit(bandwidth) if bandwidth else F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    spot = F.col("lo") - F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 2 * F.col("h")) / (points - 1)
    places = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    each = rows.crossJoin(s.withColumn("h", h)).select("*", places.alias("i")).withColumn("x", spot)
    kernel = F.exp(-F.pow((F.col("x") - F.col("__v")) / F.col("h"), 2) / 2) / math.sqrt(2 * math.pi)
    return each.groupBy("i").agg(F.first("x").alias("x"), (F.sum(kernel / F.col("h")) / F.first("n")).alias("density")).drop("i")


def bootstrap_mean(df: DataFrame, column: str, order: str, by: list[str], draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high): percentile interval of the mean over resamples with replacement.

    Draw d takes as its i-th value the one of rank md5(seed, d, i) modulo n in the group's `order`: the same draws for a
    seed anywhere, also in SQL. Groups are what a plot's points are, small; of a group the values travel as one array.
    """
    rows = df.filter(F.col(column).isNotNull())
    values = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]).alias("v"))
    each = values.select(*by, F.size("v").alias("n"), "v", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    rank = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("d"), i).cast("binary")), 1, 12), 16, 10).cast("long"), F.col("n")).cast("int")
    picked = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("v"), rank(i)))
    means = each.select(*by, "n", (F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / F.col("n")).alias("m"))
    tail = (1 - level) / 2
    ends = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean")).join(ends, by).select(*by, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
