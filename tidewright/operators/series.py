"""Monthly series: guarded windows, standardisation, regimes and interval flags. Windows need `by` on anything but a short series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _frame(order: str, rows: int | None, by: tuple[str, ...]):
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return w.rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)


def rolling(agg, column: str, order: str, rows: int | None, least: int, by: tuple[str, ...] = ()) -> Column:
    """agg over the last `rows` rows (all so far for None), NULL before `least` values are there."""
    w = _frame(order, rows, by)
    return F.when(F.count(column).over(w) >= least, agg(column).over(w))


def zscore(df: DataFrame, columns: list[str], order: str = "month", least: int = 36, by: tuple[str, ...] = ()) -> DataFrame:
    """Columns by their mean and standard deviation so far."""
    z = lambda c: F.try_divide(F.col(c) - rolling(F.avg, c, order, None, least, by), rolling(F.stddev_samp, c, order, None, least, by))
    return df.withColumns({c: z(c) for c in columns})


def volatility_scaled(df: DataFrame, columns: list[str], order: str = "month", rows: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c), rolling(F.stddev_samp, c, order, rows, rows, by)) for c in columns})


def skip_first(df: DataFrame, n: int, order: str = "month") -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.orderBy(order))).filter(F.col("__rn") > n).drop("__rn")


def standardised(df: DataFrame, columns: list[str], target: str, order: str = "month", burn_in: int = 36, rows: int = 12) -> DataFrame:
    """Predictors by expanding z-scores, the target by its rolling volatility, the burn-in left out."""
    return skip_first(volatility_scaled(zscore(df, columns, order, burn_in), [target], order, rows), burn_in, order)


def pct_change(column: str, order: str = "month", by: tuple[str, ...] = ()) -> Column:
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return F.try_divide(F.col(column), F.lag(column).over(w)) - 1


def log_ratio(a: Column, b: Column) -> Column:
    """ln a - ln b; NULL where either is not positive."""
    return F.ln(a) - F.ln(b)


def regime(column: Column, high: float = 25.0, low: float = 15.0) -> Column:
    """1 from high on, -1 up to low, else 0; NULL is 0."""
    return F.when(column >= high, 1).when(column <= low, -1).otherwise(0)


def in_intervals(df: DataFrame, intervals: DataFrame, date: str = "month", name: str = "flag") -> DataFrame:
    """df with 1 where the date lies in any [peak, trough]; intervals: a few rows."""
    few = F.broadcast(intervals.select("peak", "trough"))
    hit = df.select(date).distinct().join(few, F.col(date).between(F.col("peak"), F.col("trough")), "left_semi").withColumn(name, F.lit(1))
    return df.join(hit, date, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def asof(left: DataFrame, right: DataFrame, left_date: str, right_date: str, value: str) -> DataFrame:
    """left with the value of the last right row dated no later (NULL values don't count).

    Rows meet month by month in one union and one window. A month's first rows take the last value of earlier months from
    a table of a row per month, so no task holds more than a month of either side.
    """
    found = right.filter(F.col(value).isNotNull() & F.col(right_date).isNotNull()).select(F.col(right_date).alias("__t"), F.col(value).alias("__v"))
    a = left.select(F.col(left_date).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = found.select("__t", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__v")
    both = a.unionByName(b).withColumn("__month", F.trunc("__t", "MM"))
    w = Window.partitionBy("__month").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    months = both.groupBy("__month").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__last"))  # a row per month
    earlier = months.select(F.col("__month").alias("__m"), F.last("__last", ignorenulls=True).over(Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    rows = near.join(F.broadcast(earlier), near["__month"].eqNullSafe(earlier["__m"]), "left")
    return rows.select("__row.*", F.coalesce("__near", "__before").alias(value))
