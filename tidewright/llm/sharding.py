"""Sharding by extendible hashing.

A row's place is a string of bits: 60 of its key's SHA-256, then 60 of a hash of its row number, so that even one key
with a third of all rows can be split. The directory starts with one bucket of no bits; a bucket over the byte limit is
split on its next bit, and only such buckets are. Splitting goes by rounds of `step` bits: one aggregation with partial
sums gives the bytes of all buckets of the next `step` bits, and only rows in buckets that are still too large take part
in another round. Nothing is gathered per bucket; the directory has about two entries per shard.

Defined results: null and empty texts have no bytes; null keys hash like the word null; rows that repeat a key may go to
different shards only where they must; a single row larger than the limit is alone in its shard; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import stage, table

BITS = 60


def _bits(hex15) -> Column:
    return F.lpad(F.conv(hex15, 16, 2), BITS, "0")


def directory(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(shard, shard_bytes) from rows (bits, bytes): the shortest prefixes whose rows fit the limit."""
    found, open_, depth = [], None, 0
    while depth < 2 * BITS:
        deeper = min(depth + step, 2 * BITS)
        part = rows if open_ is None else rows.join(open_, F.substring("bits", 1, depth) == F.col("prefix"), "left_semi")
        cells = part.groupBy(F.substring("bits", 1, deeper).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        levels = cells.select(F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"), "cell", "bytes", "n")
        nodes = stage(levels.groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "nodes")
        big = (F.col("bytes") > limit) & (F.col("n") > 1)
        if deeper == 2 * BITS:
            big &= F.col("depth") < deeper
        parents = nodes.filter(big).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        child = nodes.filter(~big & (F.col("depth") > depth)).withColumn("up", F.substring("prefix", F.lit(1), F.col("depth") - 1))
        found.append(child.join(parents, ["depth", "up"]).select(F.col("prefix").alias("shard"), F.col("bytes").alias("shard_bytes")))
        if depth == 0:
            found.append(nodes.filter(~big & (F.col("depth") == 0)).select(F.col("prefix").alias("shard"), F.col("bytes").alias("shard_bytes")))
        open_ = nodes.filter(big & (F.col("depth") == deeper)).select("prefix")
        if deeper == 2 * BITS or not open_.limit(1).count():
            break
        depth = deeper
    return stage(reduce(DataFrame.unionByName, found), "directory")


def sharded(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text", step: int = 12) -> DataFrame:
    """(key, n_bytes, shard, shard_bytes) for every row of docs; limit: bytes of text per shard."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key_col).alias("key"), F.substring(F.sha2(key, 256), 1, 15).alias("one"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"),
    )
    rows = stage(rows, "rows").withColumn("bits", F.concat(_bits(F.col("one")), _bits(F.substring(F.sha2(F.col("row").cast("string"), 256), 1, 15))))
    shards = directory(rows.select("bits", "bytes"), limit, step)
    depths = sorted(r[0] for r in shards.select(F.length("shard").alias("d")).distinct().collect())  # at most 121 numbers
    tries = rows.select("key", F.col("bytes").alias("n_bytes"), F.explode(F.transform(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>"), lambda d: F.substring(F.col("bits"), F.lit(1), d))).alias("shard"))
    return tries.join(shards, "shard").select("key", "n_bytes", "shard", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet under path, a folder per shard. Keys must be unique."""
    placed = sharded(docs, limit, key_col, text_col).select(F.col("key").alias(key_col), F.concat(F.lit("s"), "shard").alias("shard"))
    docs.join(placed, key_col).repartition("shard").write.partitionBy("shard").parquet(path)


LIMIT = 1 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 1 MiB of text."""
    return sharded(table(spark, sf_dir, "documents"), LIMIT).withColumnRenamed("key", "doc_id")


#: For tables whose keys differ, which need no second hash. 24 levels are as many as any table here can need.
SQL = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(bin(('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
nodes AS (SELECT d, substr(bits, 1, d) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS n FROM (SELECT *, unnest(range(0, 25)) AS d FROM r) GROUP BY ALL),
leaves AS (SELECT c.d, c.prefix AS shard, c.bytes AS shard_bytes FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.prefix = substr(c.prefix, 1, p.d)
    WHERE (c.bytes <= {LIMIT} OR c.n = 1) AND (c.d = 0 OR (p.bytes > {LIMIT} AND p.n > 1)))
SELECT doc_id, n_bytes, shard, shard_bytes FROM r JOIN leaves ON shard = substr(bits, 1, d)
"""
