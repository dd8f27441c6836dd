"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector is shared by all grades: a text's score is the sum of the
weights of its distinct hashed features, and P(grade >= k) = sigmoid(score - threshold_k) with ordered thresholds. So a
text has an expected grade and tail probabilities; it is kept when P(grade >= 2) reaches `least`.

Features are words (lower-cased, each hashed twice, so that a chance collision carries half a weight) and binned shares of
the text's make-up (symbols, capitals, repeated words and so on), all in one hashed space.

Fitting takes at most `max_rows` labelled rows (the documented bound: 20,000 by default, those whose identifiers hash
lowest); only their hashed features come to the driver, a partition at a time. Fitting is follow-the-regularised-leader with an L1 penalty,
in numpy and in a seeded order, and gives the same model for the same rows. Scoring is one Arrow pass over all texts
without a shuffle; the model has a fixed size (4 bytes * 2**bits).

Defined results: a null or empty text is scored by its make-up alone; labels with null identifiers or unclear grades are
left out; labels that repeat an identifier count as the lowest grade; without labelled rows every text is kept with
probability one; repeated rows and clashing columns of the documents are scored as they are. Identifiers of rated rows are
64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import table

GRADES = 3
_SHARES = ("symbols", "capitals", "digits", "same_as_before", "distinct", "stops", "bars", "word_bytes", "high_bytes", "marked", "size")


def _tables() -> dict[str, np.ndarray]:
    sets = {"symbols": b"#$%&*@^~!+=<>{}[]\\/_", "stops": b".,;:?", "bars": b"|", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "letters": bytes(range(97, 123)), "high": bytes(range(128, 256)), "lines": b"\n"}
    found = {}
    for name, of in sets.items():
        found[name] = np.zeros(256, dtype=np.int32)
        found[name][list(of)] = 1
    return found


_TABLE = _tables()


def features(texts: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text, feature) by runs of texts, each text's features distinct and sorted."""
    space = np.uint64((1 << bits) - 1)
    for first, data, offsets in kernels.parts(texts):
        n = len(offsets) - 1
        hashed, text, start, end = kernels.words(data, offsets, kernels.MARKS)
        size = np.diff(offsets)
        count = {}
        for name, of in _TABLE.items():
            total = np.concatenate([[0], np.cumsum(of[data])])
            count[name] = total[offsets[1:]] - total[offsets[:-1]]
        n_words = np.bincount(text, minlength=n)
        order = np.lexsort((hashed, text))
        t, h = text[order], hashed[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
        t, h = t[new], h[new]
        distinct = np.bincount(t, minlength=n)
        again = np.zeros(len(hashed), dtype=bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])
        # words that run into a symbol: letter, then a symbol
        letter = (_TABLE["letters"] + _TABLE["capitals"] + _TABLE["high"] + _TABLE["stops"])[data] > 0
        meets = np.zeros(len(data) + 1, dtype=np.int32)
        meets[1:-1] = letter[:-1] & (_TABLE["symbols"][data][1:] > 0) if len(data) > 1 else 0
        total = np.cumsum(meets)
        marked = total[np.maximum(offsets[1:] - 1, 0)] - total[np.minimum(offsets[:-1], len(data))] if len(data) else np.zeros(n)
        over = lambda a, b: a / np.maximum(b, 1)
        shares = np.stack([
            over(count["symbols"], size), over(count["capitals"], count["letters"] + count["capitals"]), over(count["digits"], size),
            over(np.bincount(text, weights=again, minlength=n), n_words), over(distinct, n_words), over(count["stops"], n_words), over(count["bars"], n_words),
            np.minimum(over(np.bincount(text, weights=end - start, minlength=n), n_words) / 20, 1), over(count["high"], size), over(marked, n_words), np.log2(size + 1) / 24,
        ], axis=1)
        step = np.minimum(np.ceil(np.sqrt(np.clip(shares, 0, 1)) * 12), 12).astype(np.uint64)
        made = kernels.mix(np.arange(1, len(_SHARES) + 1, dtype=np.uint64) * np.uint64(1000003) + step) & space
        row = np.concatenate([np.repeat(np.arange(n), len(_SHARES)), t, t])
        feature = np.concatenate([made.ravel(), h & space, kernels.mix(h ^ np.uint64(0x5851F42D4C957F2D)) & space]).astype(np.int64)
        key = np.unique(row.astype(np.int64) << bits | feature)
        yield first, key >> bits, (key & int(space)).astype(np.int32)


@dataclass(frozen=True)
class Ordinal:
    """weights of 2**bits features and the thresholds of grades 1, 2, ..."""

    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, row, feature in features(texts, self.bits):
            got = np.bincount(row, weights=self.weights[feature])
            out[first : first + len(got)] = got
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def grade_slopes(score: float, grade: int, theta: np.ndarray) -> tuple[float, float, float]:
    """(P(grade), derivative of log P by the score through the threshold below it, the same through the one above), with
    thresholds theta[0] = -inf, ..., theta[-1] = inf: P = sigmoid(score - theta[grade]) - sigmoid(score - theta[grade + 1])."""
    sigmoid = lambda x: 1 / (1 + np.exp(-min(max(x, -40.0), 40.0)))
    low, high = sigmoid(score - theta[grade]), sigmoid(score - theta[grade + 1])
    p = max(low - high, 1e-6)
    return p, low * (1 - low) / p, high * (1 - high) / p


def fit(bounds: np.ndarray, feats: np.ndarray, grades: np.ndarray, bits: int, grades_n: int = GRADES, l1: float = 3.0, l2: float = 1.0, rate: float = 0.1, passes: int = 5, least_steps: int = 20_000, least_rows: int = 4, seed: int = 1) -> Ordinal:
    """Fit on the features feats[bounds[i]:bounds[i + 1]] of each row i, by follow-the-regularised-leader with an L1
    penalty: weights of rare features stay zero. Few rows are passed over more often, to least_steps steps. feats is
    overwritten, if it may be, with the numbers of the features that are kept."""
    n = len(grades)
    if n == 0:
        return Ordinal(bits, np.zeros(1 << bits, dtype=np.float32), np.full(grades_n - 1, -1e3))
    chunk = 1 << 20  # counts and look-ups by chunks: their 64-bit copies stay small
    seen = np.zeros(1 << bits, dtype=np.int32)
    for at in range(0, len(feats), chunk):
        seen += np.bincount(feats[at : at + chunk], minlength=1 << bits).astype(np.int32)
    names = np.flatnonzero(seen >= min(least_rows, max(1, n // 10)))
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    slot, at, stops = feats if feats.flags.writeable else feats.copy(), 0, [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = place[slot[a:b]]
        own = own[own >= 0]
        slot[at : at + len(own)] = own
        at += len(own)
        stops.append(at)
    bounds = stops
    del seen, place
    share = np.array([((grades >= k).sum() + 0.5) / (n + 1) for k in range(1, grades_n)])
    theta = np.concatenate([[-np.inf], -np.log(share / (1 - share)), [np.inf]])
    z, q, t2 = np.zeros(len(names)), np.zeros(len(names)), np.ones(grades_n + 1)
    rng = np.random.default_rng(seed)

    def weights(j: np.ndarray) -> np.ndarray:
        zj = z[j]
        return -np.sign(zj) * np.maximum(np.abs(zj) - l1, 0) / ((1 + np.sqrt(q[j])) / rate + l2)

    for _ in range(max(passes, -(-least_steps // n))):
        for i in rng.permutation(n):
            j, y = slot[bounds[i] : bounds[i + 1]], grades[i]
            w = weights(j)
            _, dl, dh = grade_slopes(float(w.sum()), y, theta)
            g = -(dl - dh)
            z[j] += g - (np.sqrt(q[j] + g * g) - np.sqrt(q[j])) / rate * w
            q[j] += g * g
            for k, d in ((y, dl), (y + 1, -dh)):
                if 0 < k < grades_n:
                    t2[k] += d * d
                    theta[k] -= rate * d / np.sqrt(t2[k])
            theta[1:-1] = np.maximum.accumulate(theta[1:-1])
    out = np.zeros(1 << bits, dtype=np.float32)
    out[names] = weights(np.arange(len(names)))
    return Ordinal(bits, out, theta[1:-1])


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade) from labels of quality (0/1) and toxicity (0/1)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    each = labels.select(F.col("doc_id").alias("id"), grade.alias("grade")).filter("id is not null and grade is not null")
    return each.groupBy("id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 20, max_rows: int = 20_000, **options) -> Ordinal:
    """A model from rated (id, grade) rows and the texts they belong to."""
    # at most max_rows rows of two numbers: may be broadcast
    chosen = F.broadcast(rated.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "text", "grade")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grade = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, row, feature in features(batch.column(1), bits):
                stops = np.searchsorted(row, np.arange(int(row[-1]) + 2) if len(row) else [0])
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[first : first + len(stops) - 1], pa.int64()), "grade": pa.array(grade[first : first + len(stops) - 1], pa.int32()),
                    "feats": pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)], pa.binary()),
                })

    # of rows that repeat an identifier one is used, so that no more than max_rows come
    rows = texts.mapInArrow(kernels.trimmed(pack), "id long, grade int, feats binary").groupBy("id").agg(F.min("grade").alias("grade"), F.min("feats").alias("feats"))
    came = sorted(((r["id"], r["grade"], np.frombuffer(r["feats"], dtype="<i4")) for r in rows.toLocalIterator()), key=lambda r: r[0])
    bounds = np.concatenate([[0], np.cumsum([len(x) for _, _, x in came])]).astype(np.int64)
    grades = np.array([y for _, y, _ in came], dtype=np.int64)
    feats = np.concatenate([x for _, _, x in came]) if came else np.zeros(0, dtype=np.int32)
    del came
    model = fit(bounds, feats, grades, bits, **options)
    del feats
    kernels.trim()  # the driver's too
    return model


def rated_texts(model: Ordinal, text: Column, spark: SparkSession) -> Column:
    """struct(score, expected_grade, p_poor_or_better, p_good) of a column of texts."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,expected_grade:double,p_poor_or_better:double,p_good:double>")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in texts:
                score = sent.value.score(batch)
                tails = sent.value.tails(score)
                yield pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in (score, tails.sum(axis=1), tails[:, 0], tails[:, -1])], names=["score", "expected_grade", "p_poor_or_better", "p_good"])
        finally:
            kernels.trim()

    return rate(F.coalesce(text.cast("string"), F.lit("")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose P(good) reaches `least`, with their own columns."""
    columns = docs.columns
    model = train(docs, graded(labels), **options)
    rated = docs.withColumn("__rated", rated_texts(model, docs[options.get("text_col", "text")], docs.sparkSession))
    return rated.filter(F.col("__rated.p_good") >= least).select(*(F.col(f"`{c}`") for c in columns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, tail probabilities and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    rated = docs.select("doc_id", rated_texts(model, docs["text"], spark).alias("r"))
    return rated.select("doc_id", "r.expected_grade", "r.p_poor_or_better", "r.p_good", (F.col("r.p_good") >= 0.5).alias("kept"))
