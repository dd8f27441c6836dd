"""Sources: predictor files, recession dates, cached metrics, and the panels derived from order lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.clean import compound, members
from tidewright.operators.series import log_ratio, pct_change

#: Columns of a predictor file, fixed by its format.
RAW_PREDICTORS = ["D12", "E12", "b/m", "tbl", "AAA", "BAA", "lty", "ntis", "infl", "ltr", "corpr", "svar"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_predictors(spark: SparkSession, path: str) -> DataFrame:
    """Monthly predictors from CSV: yyyymm parsed, thousands separators removed, spreads and log ratios derived, incomplete months dropped."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.expr(f"try_cast(regexp_replace(`{c}`, ',', '') as double)")
    rows = raw.select(F.to_date(F.try_to_timestamp(F.col("yyyymm"), F.lit("yyyyMM"))).alias("month"), number("Index").alias("prices"), *(number(c).alias(c) for c in RAW_PREDICTORS)).filter("month is not null")
    w = Window.orderBy("month")
    return rows.select(
        "month", "b/m", (F.col("corpr") - F.col("ltr")).alias("dfr"), (F.col("BAA") - F.col("AAA")).alias("dfy"), log_ratio(F.col("D12"), F.col("prices")).alias("dp"),
        log_ratio(F.col("D12"), F.lag("prices").over(w)).alias("dy"), log_ratio(F.col("E12"), F.col("prices")).alias("ep"), log_ratio(F.col("D12"), F.col("E12")).alias("de"),
        "infl", "ltr", "lty", "ntis", "svar", "tbl", (F.col("lty") - F.col("tbl")).alias("tms"), pct_change("prices").alias("returns"),
    ).dropna()


def load_recessions(spark: SparkSession, path: str) -> DataFrame:
    """(peak, trough) from CSV; spells without a peak are left out."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*(F.expr(f"try_cast({c} as date)").alias(c) for c in ("peak", "trough"))).filter("peak is not null")


def load_or_run(spark: SparkSession, path: str, run, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at path, made by run() if it isn't there yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        run().write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, or CSV by suffix."""
    if path.endswith(".csv"):
        df.write.option("header", True).csv(path)
    else:
        df.write.partitionBy(*partition_by).parquet(path)


def ensure_dirs(spark: SparkSession, *paths: str) -> None:
    """Make folders that aren't there, on whatever file system their paths name."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def write_nested(results: dict[str, DataFrame], path: str, key: str = "run") -> None:
    """Tables of one schema by name as one Parquet table, partitioned by the name."""
    for name, df in results.items():
        df.withColumn(key, F.lit(name)).write.mode("append").partitionBy(key).parquet(path)


def read_signals(raw: DataFrame, start: str | None = None, end: str | None = None, id: str = "permno", month: str = "yyyymm") -> DataFrame:
    """A signal panel as it comes: months parsed from yyyymm (others become NULL), rows without a key dropped, months
    outside [start, end] left out, in order of entity and month."""
    parsed = F.to_date(F.try_to_timestamp(F.col(month).cast("string"), F.lit("yyyyMM")))
    rows = raw.withColumn(month, parsed).dropna(subset=[id, month])
    if start is not None:
        rows = rows.filter(F.col(month) >= F.trunc(F.lit(start).cast("date"), "MM"))
    if end is not None:
        rows = rows.filter(F.col(month) <= F.trunc(F.lit(end).cast("date"), "MM"))
    return rows.orderBy(id, month)


def index_returns(returns: DataFrame, spells: DataFrame, delistings: DataFrame | None = None, start: str = "1980-01-01", end: str | None = None) -> DataFrame:
    """Monthly returns of entities while they are in the index: (permno, date, ret, ..., yyyymm), sorted.

    returns: permno, date, ret and further columns; spells: permno, start, ending (NULL: still in); delistings: permno,
    dlstdt, dlret, which adds dlret and ret_adj, both returns compounded. The dates are filtered first, so that the
    filter reaches the scan.
    """
    rows = returns.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end).cast("date"))
    rows = members(rows, spells, date="date").drop("start", "ending")
    if delistings is not None:
        last = delistings.select("permno", F.col("dlstdt").alias("date"), "dlret")
        rows = rows.join(last, ["permno", "date"], "left").withColumn("ret_adj", compound("ret", "dlret"))
    return rows.withColumn("yyyymm", F.trunc("date", "MM")).orderBy("permno", "date")


def read_returns_jdbc(spark: SparkSession, url: str, start: str, end: str | None = None, tables: tuple[str, str, str] = ("msf", "msp500list", "msedelist"), adjust: bool = True, **options) -> DataFrame:
    """index_returns() of a database's tables of returns, spells and delistings; the date filter is pushed down."""
    returns, spells, last = (spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in tables)
    return index_returns(returns, spells, last if adjust else None, start, end)


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel (permno, month): rev, qty, disc, tax, n, mcap, ret (simple) and lret (log, scaled by ten), rounded at the source."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), F.trunc("l_shipdate", "MM").alias("month")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("rev"), F.round(F.avg("l_quantity"), 8).alias("qty"), F.round(F.avg("l_discount"), 8).alias("disc"),
        F.round(F.avg("l_tax"), 8).alias("tax"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("mcap"),
    )
    w = Window.partitionBy("permno").orderBy("month")
    return rows.withColumn("ret", F.col("rev") / F.lag("rev").over(w) - 1).withColumn("lret", F.round((F.ln("rev") - F.ln(F.lag("rev").over(w))) / 10, 8))


def market_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by month: the same measures over all suppliers, returns, and the spread of quantities as a volatility index."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("rev"), F.round(F.avg("l_quantity"), 8).alias("qty"), F.round(F.avg("l_discount"), 8).alias("disc"),
        F.round(F.avg("l_tax"), 8).alias("tax"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("mcap"),
        F.round(F.stddev_samp("l_quantity"), 8).alias("vol"),
    )
    return rows.withColumn("returns", F.round(pct_change("rev"), 8))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(permno, month, y_true, y_pred): the discount's deviation as a forecast of lret."""
    return supplier_month(spark, sf_dir).filter("lret is not null").select("permno", "month", F.col("lret").alias("y_true"), F.round(F.col("disc") - 0.05, 8).alias("y_pred"))
