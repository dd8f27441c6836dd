"""Universes by market value: each month's largest, applied to the next month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_market_cap(df: DataFrame, cap: str = "mcap", top_n: int | None = None, top_share: float | None = None, is_log: bool = False, month: str = "month", id: str = "permno") -> DataFrame:
    """(month, id) of the month's universe: the top_n by value, and/or the largest until top_share of all value is covered."""
    if top_share is not None and not 0 < top_share <= 1:
        raise ValueError("top_share lies in (0, 1]")
    rows = df.filter(F.col(cap).isNotNull() & ~F.isnan(cap) & (F.abs(cap) != float("inf"))).select(month, id, cap)
    by = Window.partitionBy(month)
    rows = rows.withColumn("__v", F.exp(F.col(cap) - F.max(cap).over(by)) if is_log else F.greatest(cap, F.lit(0.0)))
    down = by.orderBy(F.col("__v").desc(), id)
    if top_n is not None:
        rows = rows.withColumn("__rn", F.row_number().over(down)).filter(F.col("__rn") <= top_n)
    if top_share is not None:
        upto = down.rowsBetween(Window.unboundedPreceding, 0)
        before = F.try_divide(F.sum("__v").over(upto) - F.col("__v"), F.sum("__v").over(by))
        rows = rows.withColumn("__before", before).filter(F.col("__before") < top_share)
    return rows.select(month, id)


def previous_month(universe: DataFrame, months: DataFrame, month: str = "month") -> DataFrame:
    """The universe of each month, re-keyed to the next month that occurs in months."""
    following = months.select(month).distinct().withColumn("__next", F.lead(month).over(Window.orderBy(month)))
    return universe.join(F.broadcast(following), month).filter("__next is not null").select(F.col("__next").alias(month), *(c for c in universe.columns if c != month))


def within(df: DataFrame, universe: DataFrame, month: str = "month", id: str = "permno") -> DataFrame:
    return df.join(universe, [month, id], "left_semi")
