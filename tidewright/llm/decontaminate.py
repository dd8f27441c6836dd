"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed in k-grams, and of every w consecutive k-grams the least hash is kept as a fingerprint. Two texts that
share a span of t = w + k - 1 words share the least hash of that span, so joining fingerprints of documents and items
misses no shared span of t words. Hits are extended: in the documents that the join found, the t-word spans whose least
hash was hit are compared word by word with the items' spans. Items shorter than `window` words are one span of their
own length; each such length t that occurs adds its own fingerprints (k = min(5, t)).

A fingerprint hit is a filter only; what is reported rests on equal words. Fingerprints are exploded where they are made
and meet the items' in a join that Spark may broadcast by size (the items' side is a staged table of known size); only
documents that were hit are read for their text again, picked by a bitmap filter of bounded size. Per document at most
its own spans are gathered, and a passage that a third of all documents share costs each of them a row per word.

Defined results: null text has no words; a document without hits has n_items 0 and the digest of the empty string; items
without words match nothing; a null item_id or doc_id is kept as null (a null item_id is not listed in the digest but
counts); repeated documents get a row each; repeated items count once per item_id; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import key_filter, may_contain, stage, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: The other characters up to 0x7F end words.
BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _spread(df: DataFrame, name: str, width: int, both: Callable[[Column, Column], Column]) -> DataFrame:
    """Column `name` (an array) with both() of `width` neighbours in each place, by doubling: a step of its own, so that
    each array is made once; the last places, which have fewer neighbours, go."""
    have = 1
    while have < width:
        step = min(have, width - have)
        df = df.withColumn(name, F.zip_with(name, F.slice(name, F.lit(step + 1), F.size(name)), both))
        have += step
    return df.withColumn(name, F.slice(name, F.lit(1), F.greatest(F.size(name) - (width - 1), F.lit(0)))) if width > 1 else df


def winnowed(df: DataFrame, t: int, k: int = 5) -> DataFrame:
    """df (hashes: of words, ...) with m: the fingerprint of each span of t words, in order."""
    k = min(k, t)
    grams = _spread(df.withColumn("m", F.col("hashes")), "m", k, lambda x, y: F.xxhash64(x, y))
    return _spread(grams, "m", t - k + 1, lambda x, y: F.least(x, y))


def hashed(df: DataFrame) -> DataFrame:
    """df (words, ...) with hashes of its words."""
    return df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))


def name_of(id: Column, text: Column) -> Column:
    """A 128-bit name of a row."""
    return F.struct(F.xxhash64(id, text).alias("x"), F.xxhash64(F.lit(1), text, id).alias("y"))


def _spans(items: DataFrame, t: int, whole: bool) -> DataFrame:
    """(t, m, span, item_ids): the spans of t words of items; whole: of items of just t words, else of t words and more."""
    fit = items.filter(F.size("words") == t if whole else F.size("words") >= t)
    at = F.explode(F.transform("m", lambda m, i: F.struct(m.alias("m"), F.array_join(F.slice("words", i + 1, t), " ").alias("span"))))
    each = winnowed(hashed(fit), t).select("item", at.alias("x")).select("item", "x.m", "x.span")
    return each.groupBy("span").agg(F.first("m").alias("m"), F.array_sort(F.collect_set("item")).alias("item_ids")).select(F.lit(t).alias("t"), "m", "span", "item_ids")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, key, n_words, n_hit, item_ids, positions) for every row of docs; key: a 128-bit name of id and text."""
    items = benchmark.select(F.struct(F.col(item_col).cast("string").alias("id")).alias("item"), words_of(F.col(item_text_col).cast("string")).alias("words"))
    items = stage(items.filter(F.size("words") > 0), "items")
    # at most window - 1 numbers come to the driver
    short = sorted(r[0] for r in items.select(F.size("words").alias("t")).filter(F.col("t") < window).distinct().collect())
    sizes = [*short, window]
    spans = stage(reduce(DataFrame.unionByName, [_spans(items, t, t < window) for t in sizes]), "spans")
    prints = stage(spans.select("t", "m").distinct(), "prints")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", name_of(F.col("id"), F.col("text")))
    found = hashed(texts.select("id", "key", words_of(F.col("text")).alias("words"))).withColumn("n_words", F.size("words").cast("long")).drop("words")
    for t in sizes:
        found = winnowed(found, t).withColumn(f"m{t}", F.array_distinct("m")).drop("m")
    found = stage(found.drop("hashes"), "fingerprints")
    meets = reduce(DataFrame.unionByName, [found.select("key", F.lit(t).alias("t"), F.explode(f"m{t}").alias("m")) for t in sizes])
    hit = stage(meets.join(prints, ["t", "m"]).groupBy("key").agg(F.collect_set(F.struct("t", "m")).alias("hits")), "hit")

    suspects = texts.crossJoin(F.broadcast(key_filter(hit, "key"))).filter(may_contain(F.col("bits"), F.col("key"))).drop("bits")
    suspects = suspects.dropDuplicates(["key", "text"]).join(hit, "key").select("key", "hits", words_of(F.col("text")).alias("words"))
    per = []
    for t in sizes:
        own = F.transform(F.filter("hits", lambda x: x["t"] == t), lambda x: x["m"])
        at = F.filter(F.transform("m", lambda m, i: F.when(F.array_contains("own", m), i + 1)), lambda i: i.isNotNull())
        # no filter on m: pushed down, it would be worked out inside the predicate again
        cut = winnowed(hashed(suspects.withColumn("own", own)), t)
        per.append(cut.withColumn("pos", F.explode(at)).select("key", F.lit(t).alias("t"), "pos", F.array_join(F.slice("words", F.col("pos"), t), " ").alias("span")))
    exact = reduce(DataFrame.unionByName, per).join(spans.select("t", "span", "item_ids"), ["t", "span"])
    each = exact.groupBy("key").agg(F.collect_set(F.struct("pos", "t")).alias("at"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["t"] - 1))))
    each = each.select("key", covered.alias("positions"), F.transform("item_ids", lambda x: x["id"]).alias("item_ids"))
    return found.select("id", "key", "n_words").join(each, "key", "left").select(
        "id", "key", "n_words", F.coalesce(F.array_size("positions"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("positions", F.array().cast("array<int>")).alias("positions"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that share a span with the benchmark."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = stage(contamination(docs, benchmark, **options).filter("n_hit > 0").select(F.col("key").alias("__bad")).distinct(), "contaminated")
    return without(docs, bad, name_of(docs[id_col], docs[text_col].cast("string")), "__bad")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of ten words of any benchmark item, in all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.filter("item_ids", lambda x: x.isNotNull())), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
spans AS (SELECT DISTINCT item_id, least(len(w), 10) AS t, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT t FROM spans),
places AS (SELECT doc_id, t, i, array_to_string(w[i:i + t - 1], ' ') AS span
    FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS i FROM w, sizes WHERE len(w) >= t)),
hits AS (SELECT doc_id, i, t, item_id FROM places JOIN spans USING (t, span)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM hits) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""
