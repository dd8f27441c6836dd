"""Exact dedup by a log-structured merge index, in DataFrame operations only.

The texts are read once into a narrow table of digests, which enters the index in `batches`. A batch's memtables (what each
task holds of it) are summed up to a row per digest, with partial aggregation, so that a digest of a third of all rows
arrives as one row per task; they are flushed, sorted by digest, as a run of level 0 with a filter of bounded size. `fanout`
runs of a level are compacted into one of the next, which keeps one identifier and the row count of each digest. A new
run's digests are looked up in the runs before it: by their filters first, and only what those may hold in a join.

Digests of several rows are hits, and hits receive byte verification: a filter picks their documents out of the scan, and
these are grouped by digest *and* text. A row takes the group of its own text, told by a second hash of it, so equal
digests of different texts stay apart. Rows without a hit need no join.

Defined results: a null text counts as empty; a null identifier loses to any other, and stays where all are null; rows
that repeat identifier and text are one group and count separately in group_size, all with kept = true; an empty table
gives an empty result; further columns of the input are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import fresh_path, key_filter, may_contain, spread_join, stage, table, without


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, id, rows), a row per digest, under one folder, merged level by level; and a filter of each run.

    keep: "smallest" or "largest" identifier of equal digests. fanout: runs on a level before they merge into the next.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest", fanout: int = 4, path: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.best = {"smallest": F.min, "largest": F.max}[keep]
        self.path = path or fresh_path(spark, "digest-index")
        self.levels: list[list[str]] = [[]]
        self.filters: dict[str, DataFrame] = {}

    def _write(self, rows: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self.path}/level={level}/run={sum(map(len, self.levels)):06d}-{fresh_path(self.spark, '').rsplit('-', 1)[1]}"
        rows.groupBy("digest").agg(self.best("id").alias("id"), F.sum("rows").alias("rows")).sortWithinPartitions("digest").write.parquet(name)
        self.levels[level].append(name)
        self.filters[name] = stage(key_filter(self.spark.read.parquet(name), "digest"), "run-filter")
        return name

    def flush(self, rows: DataFrame) -> DataFrame:
        """Flush memtables of rows (digest, id) to a new level-0 run; gives the digests of it that occur more than once by
        now, in the run or in one before. Full levels merge downwards."""
        before = [x for level in self.levels for x in level]
        name = self._write(rows.select("digest", "id", F.lit(1).cast("long").alias("rows")), 0)
        run = self.spark.read.parquet(name)
        hits = run.filter("rows > 1").select("digest")
        for older in before:
            may = run.crossJoin(F.broadcast(self.filters[older])).filter(may_contain(F.col("bits"), F.col("digest"))).select("digest")
            hits = hits.unionByName(may.join(self.spark.read.parquet(older), "digest", "left_semi"))
        hits = stage(hits.distinct(), "hits")
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return hits

    def compact(self, level: int = 0) -> None:
        """Merge all runs of a level into one run of the next; one row per digest, the kept identifier and the row count."""
        if runs := self.levels[level]:
            self._write(self.spark.read.parquet(*runs), level + 1)
            self.levels[level] = []

    def merged(self) -> DataFrame:
        """One row per digest over all levels."""
        runs = [x for level in self.levels for x in level]
        return self.spark.read.parquet(*runs).groupBy("digest").agg(self.best("id").alias("id"), F.sum("rows").alias("rows"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = sha256, batches: int = 4, fanout: int = 4
) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of docs; digest: of a text, collisions are allowed."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = texts.withColumns({"digest": digest(F.col("text")), "name": F.unhex(F.md5(F.col("text").cast("binary")))})
    rows = stage(keyed.select("id", "digest", "name"), "digests")
    index, batch = DigestIndex(spark, keep, fanout), F.pmod(F.xxhash64("id", "name"), F.lit(batches))
    hits = reduce(DataFrame.unionByName, [index.flush(rows.filter(batch == i)) for i in range(batches)])
    may_hit = stage(key_filter(hits, "digest"), "hit-filter")
    hit = may_contain(F.col("bits"), F.col("digest"))
    suspects = keyed.crossJoin(F.broadcast(may_hit)).filter(hit).select("digest", "name", "text", "id")
    groups = suspects.groupBy("digest", "name", "text").agg(index.best("id").alias("keep_id"), F.count("*").alias("group_size"))
    # the text itself may be long: only two independent hashes of each verified group are kept
    groups = stage(groups.filter("group_size > 1").select(F.concat("digest", "name").alias("key"), "keep_id", "group_size"), "verified")
    marked = rows.crossJoin(F.broadcast(may_hit)).withColumn("hit", hit).withColumn("key", F.concat("digest", "name")).drop("bits", "name")
    met = spread_join(marked.filter("hit"), groups, "key", "group_size", rows.count(), "left")
    alone = F.col("group_size").isNull()
    found = met.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
    )
    return found.unionByName(marked.filter("not hit").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the rows that exact_duplicates() drops; rows that repeat an identifier and text leave one of them."""
    found = stage(exact_duplicates(docs, id_col, text_col, keep), "exact")
    lost = found.filter("not kept").select("id", "digest").distinct()
    # an identifier may be lost with one text and kept with another: rows are told by both
    same = lambda id, digest: F.struct(F.struct(id.alias("id")).alias("of"), digest.alias("digest"))
    gone = stage(lost.select(same(F.col("id"), F.col("digest")).alias("row")), "lost")
    left = without(docs, gone, same(docs[id_col], sha256(F.coalesce(docs[text_col].cast("string"), F.lit("")))), "row")
    twice = found.filter("kept").groupBy("id", "digest").count().filter("count > 1").limit(1).count() > 0
    if not twice:
        return left
    own = f"__text_{uuid.uuid4().hex}"  # null counts as empty here too
    return left.withColumn(own, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).dropDuplicates([id_col, own]).drop(own)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over the whole of documents; the largest doc_id of equal texts stays."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
