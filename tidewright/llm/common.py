"""What the operators share: the folder all machines see, staged tables, and a membership filter of bounded size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import kernels


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which the driver and all executors share.

    Where the session names none, a local master gets a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Spark deletes the shuffle files of a query when it ends, where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths made so far, by those who want to know (scratch()).
_recording: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths that fresh_path() gives inside, for discard() once what was made from them is written."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording[:] = [x for x in _recording if x is not made]  # not an outer list that is equal


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, archives and runs that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
    kernels.trim()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recording:
        made.append(path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and the rows survive lost executors.

    The write's shuffle files go with its end, and not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as it is where its plan has no exchange, so that each task finds its rows in the same order whenever it runs; else
    staged."""
    return stage(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", share: int = 4096) -> DataFrame:
    """left joined with right on `key`, which is unique in right; `rows` there: how many of left's `total` rows have the key.

    Keys of more than total / share rows are fewer than `share`, so their rows of right are broadcast whatever the input;
    the other keys meet in a shuffle in which none has more rows than that. Both sides are read twice: pass staged tables.
    """
    most = total // share
    if most == 0:  # fewer than `share` keys have any row
        return left.join(F.broadcast(right.filter(F.col(rows) > 0)), key, how)
    if (right.agg(F.max(rows)).first()[0] or 0) <= most:
        return left.join(right, key, how)
    hot, cold = right.filter(F.col(rows) > most), right.filter(F.col(rows) <= most)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


#: Bits in one bitmap of bitmap_construct_agg, a fixed value of Spark.
BITMAP_BITS = 32768


def key_filter(keys: DataFrame, key: str, buckets: int = 512) -> DataFrame:
    """One row with `bits`: a one-hash Bloom filter over `key`, an array of `buckets` bitmaps.

    Its size is buckets * 4 KiB whatever the number of keys (2 MiB by default), so the row may always be broadcast.
    More keys raise the share of false hits and nothing else; callers verify every hit.
    """
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets * BITMAP_BITS)) + 1
    maps = (
        keys.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap"))
    )
    whole = keys.sparkSession.range(1, buckets + 1, 1, 1).withColumnRenamed("id", "bucket")
    return (
        whole.join(maps, "bucket", "left")
        .groupBy()
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "bitmap"))), lambda x: x["bitmap"]).alias("bits"))
    )


def may_contain(bits: Column, key: Column, buckets: int = 512) -> Column:
    """Whether the filter `bits` of key_filter() may hold `key`; false is certain."""
    spot = F.pmod(F.xxhash64(key), F.lit(buckets * BITMAP_BITS))
    bitmap = F.get(bits, F.floor(spot / BITMAP_BITS).cast("int"))
    bit = F.pmod(spot, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))


def without(docs: DataFrame, lost: DataFrame, key: Column, name: str) -> DataFrame:
    """docs without the rows whose key is in column `name` of lost; rows with a null key stay.

    A bitmap filter of bounded size tells most rows that stay, whole texts and all, from the few that must meet lost in a
    join. docs is read twice: pass a staged or scanned table.
    """
    bits, own, gone = (f"__{x}_{uuid.uuid4().hex}" for x in ("bits", "key", "lost"))  # no column of docs
    marked = docs.crossJoin(F.broadcast(key_filter(lost, name).withColumnRenamed("bits", bits))).withColumn(own, key)
    maybe = may_contain(F.col(bits), F.col(own)) & F.col(own).isNotNull()
    rest = marked.filter(maybe).join(lost.select(F.col(name).alias(gone)), F.col(own) == F.col(gone), "left_anti")
    return marked.filter(~maybe).unionByName(rest).drop(bits, own)
