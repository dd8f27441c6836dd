"""Best-fit packing of tokenised documents by a configuration linear program.

1. Every document becomes token ids plus an end id 0; documents longer than a sequence are cut into full pieces, of which
   the first may be shorter. Only lengths and checksums go on (a staged table).
2. The histogram of piece lengths (at most `size` rows, whatever the corpus) goes to the driver. Over it a configuration
   LP (fewest sequences such that every length's pieces are covered) is solved by multiplicative weights: each length
   has a price, an unbounded knapsack by dynamic programming finds the dearest configurations, these gain mass, and the
   prices of the lengths they cover fall. The prices also give a lower bound by duality.
3. Rounding: whole multiples of the configurations, or of a share or multiple of their mass, are used as far as pieces
   last, fullest first.
   The program is solved again over what is left, until rounding yields nothing more, and the last rest is packed best-fit,
   longest first, over counts and not over pieces. The best share stays.
4. The plan says for each length which ranks go to which sequences. Pieces get ranks without gathering a length in one
   task: they are dealt by length and a salt whose number grows with the length's count, numbered inside, and shifted by
   the counts of lower salts. The plan's size depends on the histogram's only, so it may be broadcast.

Defined results: null and empty texts are the end id alone; repeated rows are pieces of their own; null identifiers are
packed like others; an empty table gives an empty result; columns beyond identifier and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import stage, table

SIZE = 2048
TOKENIZER = "byte_bpe_50k.json"
_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


class Encoder:
    """Texts to the ids of a tokenizer file (JSON), special strings in a text included, no tokens added.

    The ids of byte-level BPE are the ranks of its merges, so such a file's vocabulary also drives the faster encoder of
    the same method; a file of another kind, and a text with a word of more than `long` bytes, is left to the file's own.
    """

    def __init__(self, path: str, long: int = 10_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.path, self.fast = path, None
        whole = self.whole
        self.long = re.compile(rf"[^ \n]{{{long}}}")
        self.special = {x.content: i for i, x in whole.get_added_tokens_decoder().items()}
        cut, model = whole.pre_tokenizer, whole.model
        bytelevel = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        if bytelevel and whole.normalizer is None and isinstance(model, BPE) and not model.ignore_merges:
            # the alphabet of byte-level BPE: printable bytes stand for themselves, others are shifted up from 256
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
            ranks = {bytes(byte[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
            del self.whole  # read again where it is needed

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or self.long.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif any(x in text for x in self.special):
            ids = self.fast.encode(text, allowed_special="all")
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, start, length, crc) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = own.encode(text.as_py()).tobytes() + b"\0\0\0\0"
                n, start = len(data) // 4, 0
                for number in range(-(-n // size)):
                    stop = n - size * ((n - 1) // size) + size * number
                    for column, value in zip(found, (i, number, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _PIECES, strict=True)], schema=_PIECES)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(kernels.trimmed(cut), "id long, piece int, start long, length long, crc long")


def _knapsack(price: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], and the length used last at c, for every capacity c; lengths ascending."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        best[c] = best[c - 1]
        if n:
            value = price[:n] + best[c - lengths[:n]]
            i = int(np.argmax(value))
            if value[i] > best[c]:
                best[c], last[c] = value[i], lengths[i]
    return best, last


def _trace(last: list[int], used: list[int], c: int) -> list[int]:
    """The lengths of the best filling of c; used[c]: the largest capacity up to c that ends in a length."""
    out = []
    while (c := used[c]) > 0:
        out.append(last[c])
        c -= last[c]
    return out


def solve(histogram: dict[int, int], size: int = SIZE, rounds: int = 120, rate: float = 0.1, fall: float = 0.5, slack: float = 0.002) -> tuple[Counter, float]:
    """Mass of each configuration (a descending tuple of lengths), and a lower bound on the number of sequences."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(x)] for x in lengths], dtype=float)
    at = {int(x): i for i, x in enumerate(lengths)}
    price = lengths / size
    bound, mass, cover = 0.0, Counter(), np.zeros(len(lengths))
    for _ in range(rounds if len(lengths) else 0):
        best, last = _knapsack(price, lengths, size)
        used = np.maximum.accumulate(np.where(last > 0, np.arange(size + 1), 0)).tolist()
        last = last.tolist()
        bound = max(bound, float(need @ price) / best[size])
        value = price + best[size - lengths]
        quota = rate * need  # what a length may gain this round
        seen = set()
        for i in np.argsort(-value, kind="stable"):
            if value[i] < (1 - slack) * best[size] and seen:
                break
            config = tuple(sorted([int(lengths[i]), *_trace(last, used, size - int(lengths[i]))], reverse=True))
            if config in seen:
                continue
            seen.add(config)
            use = Counter(config)
            step = min(quota[at[x]] / k for x, k in use.items())
            if step > 0:
                mass[config] += step
                for x, k in use.items():
                    quota[at[x]] -= step * k
        gained = rate * need - quota
        cover += gained
        price = np.maximum(price * np.exp(-fall * gained / (rate * need)), 1e-12)
    # scaled so that no length has more mass than pieces; rounding deals with the rest
    for config in list(mass):
        mass[config] /= max(1.0, *(cover[at[x]] / need[at[x]] for x in set(config)))
    return mass, bound


def best_fit(left: dict[int, int], size: int = SIZE) -> Counter:
    """Best-fit packing, longest first, of counts of lengths into counts of configurations."""
    groups: dict[int, Counter] = {}  # room left: configurations
    rooms = 0  # a bit for each room of some group
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            fit = rooms >> length
            if not fit:
                k = min(size // length, n)
                bins = n // k
                groups.setdefault(size - k * length, Counter())[(length,) * k] += bins
                rooms |= 1 << (size - k * length)
                n -= k * bins
                continue
            room = length + (fit & -fit).bit_length() - 1
            config, bins = next(iter(groups[room].items()))
            k = min(room // length, n)
            bins = min(bins, n // k)
            groups[room][config] -= bins
            if not groups[room][config]:
                del groups[room][config]
                if not groups[room]:
                    rooms ^= 1 << room
            groups.setdefault(room - k * length, Counter())[config + (length,) * k] += bins
            rooms |= 1 << (room - k * length)
            n -= k * bins
    out: Counter = Counter()
    for x in groups.values():
        out.update(x)
    return out


def rounded(histogram: dict[int, int], mass: Counter, size: int = SIZE, bound: float = 0.0, shares: tuple[float, ...] = (16.0, 8.0, 4.0, 1.0, 0.5, 0.25), again: int = 2) -> Counter:
    """Whole counts of configurations that hold every piece once: of the shares of the mass that are rounded down, the one
    whose rest packs best. The first one's rest is also solved and rounded again, `again` times at most. A result that
    meets the lower bound is taken at once."""

    def down(left: dict[int, int], mass: Counter, share: float) -> tuple[Counter, dict[int, int]]:
        left, used = dict(left), Counter()
        for config, x in sorted(mass.items(), key=lambda kv: (size - sum(kv[0]), -kv[1], kv[0])):
            use = Counter(config)
            n = min(int(x * share), *(left[length] // k for length, k in use.items()))
            if n > 0:
                used[config] += n
                for length, k in use.items():
                    left[length] -= n * k
        return used, {k: v for k, v in left.items() if v}

    found, least = [], -(-bound // 1)
    for share in shares:
        if found and sum(found[-1].values()) <= least:
            break
        used, left = down(histogram, mass, share)
        found.append(used + best_fit(left, size))
        for _ in range(again if share == shares[0] else 0):
            if sum(found[-1].values()) <= least:
                break
            more, rest = down(left, solve(left, size)[0], 1.0)
            if not more:
                break
            used, left = used + more, rest
            found.append(used + best_fit(left, size))
    return min(found, key=lambda used: sum(used.values()))


def plan(used: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, pieces per sequence, first sequence, offset) rows."""
    rows, rank, sequence = [], Counter(), 0
    for config, n in sorted(used.items()):
        offset = 0
        for length, per in sorted(Counter(config).items(), reverse=True):
            rows.append((length, rank[length], rank[length] + n * per, per, sequence, offset))
            rank[length] += n * per
            offset += length * per
        sequence += n
    return rows


def pack(docs: DataFrame, size: int = SIZE, per_salt: int = 1000, **options) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset) of every piece."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, size=size, **options), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    mass, bound = solve(histogram, size)
    rows = plan(rounded(histogram, mass, size, bound - 1e-6))
    placed = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, per long, first long, at long")
    # a length's salts by its own count: no group is much larger than per_salt
    salts = spark.createDataFrame([(k, -(-n // per_salt)) for k, n in histogram.items()] or [(0, 1)], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.col("salts"))).drop("salts")
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")
    lower = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("shift"))
    ranked = salted.withColumn("own", F.row_number().over(inside) - 1).join(shift, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("shift"))
    fits = (ranked["length"] == placed["length"]) & (ranked["rank"] >= placed["low"]) & (ranked["rank"] < placed["high"])
    seat = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(placed), fits).select(  # the plan is bounded by the histogram
        "id", "piece", "start", ranked["length"], "crc",
        (F.col("first") + F.floor(seat / F.col("per"))).cast("long").alias("sequence"), (F.col("at") + (seat % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return named(pack(table(spark, sf_dir, "documents")))


def named(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
