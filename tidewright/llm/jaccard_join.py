"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by their hashes) is cut into fragments. Every document's n-gram set is cut along with it, so
a fragment holds a segment of each document and can be counted alone:

1. Documents with the same set are one class from the start (a 96-bit name of the set; its members join by aggregation).
2. Segments are sent to their fragments in packets: of each class a number within the packet's source (a run of one task's
   documents), not its name, so that what is sent grows with the n-grams however many fragments there are. Per fragment,
   the number of classes that hold each n-gram is counted. N-grams of one class can't be shared and go. What is left
   returns to its source, where the names are; open classes go by numbers. A class that shares too few of its n-grams with anyone to reach the
   threshold can have no partner; most documents end here.
3. Candidates: with the rarest n-grams first, two sets that reach the threshold share one within both prefixes. A list of
   classes with a common prefix n-gram isn't paired off: each member meets the list's leader (twice, with different
   leaders), and what is thereby connected needs no more pairs. Only members of lists that are still in different
   components, and that could reach the threshold by where the n-gram stands, meet each other, in blocks. Nothing is capped.
4. Partial overlaps: segments of candidate pairs are intersected fragment by fragment, and the counts summed per pair.
   A pair links when 100 * overlap >= threshold * union, in whole numbers.
5. Components of links, by contraction, give the smallest identifier reached.

N-grams are told apart by hashes of 48 bits beside their fragment's number. Two n-grams of a pair of documents of 300 words
each fall together with odds of 90,000 / (2**48 * fragments), which counts one shared n-gram too many; copies of a class in
different sources are told by 32 bits and their n-grams. Keys that many rows have (a set, an n-gram, a leader) are dealt
apart by their counts, not left to adaptive execution. Sources are numbered by task, so a task that runs again must read
its rows in the same order, as scans of files do: documents that come out of a shuffle are written first, and a checksum of
the names tells where an order changed.

Defined results: null, empty and blank texts have no n-grams and link with nothing; texts of fewer than k words are one
n-gram; a null identifier gets its count but takes no part in linking; rows that repeat an identifier are one document
with the links of each of its texts; an empty table gives an empty result; other columns are never read. Identifiers are
64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import settled, spread_join, stage, table, without
from tidewright.llm.graph import components
from tidewright.llm.kernels import pack_parts, planes, unpack_parts, unplanes

_NAME = 12
_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary())])
_CUTS = pa.schema([("frag", pa.int32()), ("src", pa.int64()), ("cut", pa.binary())])
_SHARED = pa.schema([("src", pa.int64()), ("cut", pa.binary())])
_DIRECTORY, _SEGMENTS = b"D", b"S"
_OPEN = pa.schema([("cls", pa.int64()), ("name", pa.binary()), ("n", pa.int64()), ("alpha", pa.int64()), ("grams", pa.list_(pa.int64()))])
_SALT = np.uint64(0xD6E8FEB86659FD93)
_CLASS = 24  # bits of a class's number in its source


def sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, size per text, name per text as uint32 x 3, text, n-gram) by runs of texts."""
    for first, data, offsets in kernels.parts(texts):
        n = len(offsets) - 1
        hashed, text, _, _ = kernels.words(data, offsets, kernels.WHITE)
        at, gram = kernels.shingles(hashed, text, n, k)
        size = np.bincount(at, minlength=n)
        bounds = np.concatenate([[0], np.cumsum(size)])
        total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[bounds])  # noqa: E731, B023  wraps, as meant
        one, two = kernels.mix(total(kernels.mix(gram)) + size.astype(np.uint64)), kernels.mix(total(kernels.mix(gram ^ _SALT)))
        name = np.stack([one & np.uint64(0xFFFFFFFF), one >> np.uint64(32), two & np.uint64(0xFFFFFFFF)], axis=1).astype("<u4")
        yield first, size, name, at, gram


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Flags of where a new key begins in sorted rows."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def document_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, cls): set size and the name of the set, for rows (id, text)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size, names, _, _ in sets(batch.column(1), k):
                raw = names.tobytes()
                cls = pa.array([raw[i : i + _NAME] for i in range(0, len(raw), _NAME)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(size)).cast(pa.int64()), pa.array(size, pa.int64()), cls], schema=_SETS)

    return texts.mapInArrow(kernels.trimmed(name), "id long, n long, cls binary")


def _cut_sets(texts: DataFrame, k: int, fragments: int, flush: int = 1_000_000) -> DataFrame:
    """(frag, src, cut): the segments of the classes of each source, packed by fragment, and each source's directory."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple] = []
        total, turn, task = 0, 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            names, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            shift = np.cumsum([0, *(len(x[1]) for x in held)])
            at, gram = np.concatenate([x[2] + s for x, s in zip(held, shift, strict=False)]), np.concatenate([x[3] for x in held])
            held.clear()
            check = int(kernels.mix(np.cumsum(kernels.mix(names.astype(np.uint64)), axis=0)).sum()) if len(names) else 0
            src = task << 16 | turn
            if turn >> 16 or len(n) >> _CLASS:
                raise ValueError("too many sources or classes in a task")
            frag = ((gram >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            frag, at, gram = frag[order], at[order], gram[order]
            short = kernels.mix(names[:, 0].astype(np.uint64) << np.uint64(32) | names[:, 1])
            stops = np.flatnonzero(_runs(frag))
            rows = [(src % fragments, pack_parts(_DIRECTORY, check, names.tobytes(), planes(n)))]
            for a, b in zip(stops.tolist(), [*stops[1:].tolist(), len(frag)], strict=True):
                own = np.flatnonzero(_runs(at[a:b]))
                who = at[a:b][own]
                told = kernels.mix(short[who] ^ np.uint64(frag[a] + 1)) & np.uint64(0xFFFFFFFF)
                rows.append((int(frag[a]), pack_parts(_SEGMENTS, check, planes(np.diff(who, prepend=0)), told.astype("<u4").tobytes(), planes(np.diff([*own, b - a])), _six(gram[a:b]))))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([src] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], schema=_CUTS)

        for batch in batches:
            for _, size, names, at, gram in sets(batch.column(1), k):
                keep = np.zeros(len(size), dtype=bool)
                for i in np.flatnonzero(size):
                    if (key := names[i].tobytes()) not in seen:
                        seen.add(key)
                        keep[i] = True
                mine = keep[at]
                held.append((names[keep], size[keep], (np.cumsum(keep) - 1)[at[mine]], gram[mine]))
                total += int(mine.sum())
                if total >= flush:
                    yield out()
                    seen.clear()
                    total, turn = 0, turn + 1
        if total:
            yield out()

    return texts.mapInArrow(kernels.trimmed(cut), "frag int, src long, cut binary")


def _count_fragment(rows: pa.Table) -> pa.Table:
    """Of one fragment's segments: the n-grams that two or more classes hold, with their number, by source. Directories pass."""
    frag = rows.column("frag")[0].as_py()
    out: tuple[list, list] = ([], [])
    srcs, checks, who, told, counts, grams = [], [], [], [], [], []
    for src, raw in zip(rows.column("src").to_pylist(), rows.column("cut"), strict=True):
        raw = raw.as_py()
        if raw[:1] == _DIRECTORY:
            out[0].append(src)
            out[1].append(raw)
            continue
        check, (a, b, c, d) = unpack_parts(raw, 4)
        srcs.append(src)
        checks.append(check)
        who.append(np.cumsum(unplanes(a)).astype(np.int64))
        told.append(np.frombuffer(b, "<u4"))
        counts.append(unplanes(c).astype(np.int64))
        grams.append(_from_six(d))
    if srcs:
        packet = np.repeat(np.arange(len(srcs)), [len(x) for x in who])
        who, told, counts, gram = (np.concatenate(x) for x in (who, told, counts, grams))
        del grams
        # of a class's copies from several sources the first source's counts and goes on, the same one in every fragment
        total = np.add.reduceat(kernels.mix(gram), np.cumsum(counts) - counts)
        source = np.array(srcs, dtype=np.int64)[packet]
        order = np.lexsort((source, counts, total, told))
        use = np.zeros(len(who), dtype=bool)
        use[order[_runs(told[order], total[order], counts[order])]] = True
        owner = np.repeat(np.arange(len(who), dtype=np.int32), counts)
        mine = use[owner]
        owner, gram = owner[mine], gram[mine]
        order = np.argsort(gram, kind="stable")
        owner, gram = owner[order], gram[order]
        new = _runs(gram)
        held = np.diff([*np.flatnonzero(new), len(gram)])[np.cumsum(new) - 1]
        many = held > 1
        owner, gram, held = owner[many], gram[many], np.minimum(held[many], 2**31 - 1)
        order = np.argsort(owner, kind="stable")
        owner, gram, held = owner[order], gram[order], held[order]
        p = packet[owner]
        stops = np.flatnonzero(_runs(p)) if len(p) else np.zeros(0, np.int64)
        for x, y in zip(stops.tolist(), [*stops[1:].tolist(), len(p)], strict=False):
            own = np.flatnonzero(_runs(owner[x:y]))
            out[0].append(srcs[p[x]])
            out[1].append(pack_parts(_SEGMENTS, checks[p[x]], np.int64(frag).tobytes(), planes(who[owner[x:y][own]]), planes(np.diff([*own, y - x])), _six(gram[x:y]), planes(held[x:y])))
    return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], schema=_SHARED)


def _put_together(threshold: int):
    """Classes of one source that share enough n-grams to have a partner, their shared n-grams rarest first."""

    def put(rows: pa.Table) -> pa.Table:
        names = sizes = told = None
        owners, grams, helds, checks = [], [], [], set()
        for raw in rows.column("cut"):
            raw = raw.as_py()
            if raw[:1] == _DIRECTORY:
                told, (a, b) = unpack_parts(raw, 2)
                names, sizes = np.frombuffer(a, "<u4").reshape(-1, 3), unplanes(b).astype(np.int64)
                continue
            check, (f, a, b, c, d) = unpack_parts(raw, 5)
            checks.add(check)
            owners.append(np.repeat(unplanes(a), unplanes(b)))
            # the fragment is part of the n-gram's name
            grams.append(kernels.mix(_from_six(c) ^ kernels.mix(np.frombuffer(f, "<u8") * _SALT + _SALT)))
            helds.append(unplanes(d))
        if checks and checks != {told}:
            raise RuntimeError("a task that ran again read its rows in another order")
        if not grams:
            return pa.Table.from_batches([], schema=_OPEN)
        owner, gram, held = (np.concatenate(x) for x in (owners, grams, helds))
        del owners, grams, helds
        shared = np.bincount(owner, minlength=len(sizes))
        alpha = -(-threshold * sizes // 100)
        keep = shared >= alpha
        mine = keep[owner]
        owner, gram, held = owner[mine], gram[mine], held[mine]
        order = np.lexsort((gram, held, owner))
        gram = gram[order]
        bounds = np.concatenate([[0], np.cumsum(shared[keep])])
        raw = names[keep].tobytes()
        return pa.Table.from_arrays([
            pa.array((rows.column("src")[0].as_py() << _CLASS) + np.flatnonzero(keep)), pa.array([raw[i : i + _NAME] for i in range(0, len(raw), _NAME)], pa.binary()), pa.array(sizes[keep]), pa.array(alpha[keep]),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(gram.view(np.int64))),
        ], schema=_OPEN)

    return put


def _overlaps(pairs: DataFrame, segments: DataFrame, threshold: int, per_salt: int = 1000) -> DataFrame:
    """The pairs (a, na, fan, b, nb) that reach the threshold: overlaps counted fragment by fragment, then summed.

    fan: about how many pairs a is in; the segments of such an a are copied once per `per_salt` of them.
    """
    salts = F.ceil(F.col("fan") / per_salt).cast("long")
    # few pairs are broadcast by their size, and only their segments are dealt
    ends = pairs.groupBy(F.col("a").alias("cls")).agg(F.max(salts).alias("salts"))
    sa = segments.join(ends, "cls").select(F.col("cls").alias("a"), "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("grams").alias("ga"))
    sb = segments.join(pairs.select(F.col("b").alias("cls")), "cls", "left_semi").select(F.col("cls").alias("b"), "part", F.col("grams").alias("gb"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), salts))
    partial = dealt.join(sb, "b").join(sa, ["a", "salt", "part"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
    summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return summed.filter(F.col("common") * (100 + threshold) >= threshold * (F.col("na") + F.col("nb"))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80, per_fragment: int = 1_000_000, parts: int = 4, block: int = 1000) -> DataFrame:
    """(id, n, component) for every row of docs; threshold in hundredths, parts: fragments of the overlap count."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = settled(texts, "texts")
    named = stage(document_sets(texts, k), "sets")
    classes = stage(named.filter("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n")), "classes")
    size = classes.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).first()
    fragments, n_rows = max(1, -(-int(size["n"] or 0) // per_fragment)), int(size["rows"] or 0)
    shared = _cut_sets(texts.filter("id is not null"), k, fragments, min(per_fragment, 1_000_000)).groupBy("frag").applyInArrow(kernels.trimmed(_count_fragment), "src long, cut binary")
    opened = stage(shared.groupBy("src").applyInArrow(kernels.trimmed(_put_together(threshold)), "cls long, name binary, n long, alpha long, grams array<long>"), "open")

    # if this is the first n-gram that two sets share, they share no more than either has from here on (ra, rb); where it
    # isn't, the pair has met before under a looser bound
    fits = (100 + threshold) * F.least("ra", "rb") >= threshold * (F.col("na") + F.col("nb"))
    own = (F.col("n") - F.size("grams")) / F.col("n")  # the share of n-grams of its own: least for what others were made from
    prefix = opened.select("cls", "n", own.cast("float").alias("own"), F.size("grams").alias("s"), F.posexplode(F.slice("grams", 1, F.size("grams") - F.col("alpha").cast("int") + 1)).alias("at", "gram"))
    prefix = prefix.withColumn("rest", F.col("s") - F.col("at")).drop("s", "at")
    segment = lambda i: F.filter("grams", lambda g: F.pmod(g, F.lit(parts)) == i)
    segments = opened.select("cls", F.posexplode(F.array(*map(segment, range(parts)))).alias("part", "grams")).filter(F.size("grams") > 0)
    # n-grams of one list of one class connect nothing; the others' lists are known by their sizes from here on
    sizes = stage(prefix.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    n_prefix = prefix.count()
    prefix = stage(spread_join(prefix, sizes, "gram", "m", n_prefix), "prefixes")
    reps = stage(classes.select(F.col("cls").alias("name"), "rep").join(opened.select("cls", "name"), "name"), "reps")

    def star(rows: DataFrame, order) -> DataFrame:
        """Pairs of each list's members with its first."""
        lists = rows.groupBy("gram").agg(F.min(F.struct(order.alias("order"), "n", "cls", "component", "rest")).alias("lead"), F.count("*").alias("size"))
        lists = lists.select("gram", "size", F.col("lead.cls").alias("a"), F.col("lead.n").alias("na"), F.col("lead.component").alias("ca"), F.col("lead.rest").alias("ra"))
        lists = stage(lists.join(lists.groupBy("a").agg(F.max("size").alias("fan")), "a"), "lists")
        met = spread_join(rows, lists, "gram", "size", n_prefix)
        met = met.filter((F.col("component") != F.col("ca")) & (F.col("cls") != F.col("a"))).select("a", "na", "fan", "ra", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
        return met.filter(fits).select("a", "na", "fan", "b", "nb").distinct()

    def unmet(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
        if done is None:
            return pairs
        return pairs.join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")

    links, met_pairs, rows = None, None, prefix.withColumn("component", F.col("cls"))
    for order in (F.col("own"), F.xxhash64("gram", "cls"), None):
        if order is not None:
            pairs = stage(unmet(star(rows, order), met_pairs), "pairs")
        else:
            apart = rows.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x <> y").select("gram", "size")
            apart = stage(apart, "apart-lists")
            left = stage(spread_join(rows, apart, "gram", "size", n_prefix).withColumn("blocks", F.ceil(F.col("size") / block).cast("long")), "apart")
            side = lambda x: [F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("rest").alias(f"r{x}")]
            one = left.select("gram", F.col("size").alias("fan"), F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("salt"), *side("a"))
            other = left.select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), *side("b"))
            both = one.join(other, ["gram", "salt"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits)
            pairs = stage(unmet(both.groupBy("a", "na", "b", "nb").agg(F.max("fan").alias("fan")), met_pairs), "pairs")
        more = stage(_overlaps(pairs, segments, threshold), "links")
        links = more if links is None else links.unionByName(more)
        known = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        met_pairs = known if met_pairs is None else met_pairs.unionByName(known)
        of = components(links)
        if order is not None:
            mine = of.withColumnRenamed("id", "cls")
            rows = stage(prefix.join(mine, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "joined-prefixes")

    # a component is named by a class so far, and has the smallest identifier of its classes
    linked = stage(reps.select("cls", F.col("name").alias("set"), "rep").join(of.withColumnRenamed("id", "cls"), "cls"), "linked")
    least = stage(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("size")), "least")
    of = spread_join(linked, least, "component", "size", linked.count()).select(F.col("set").alias("cls"), "least")
    of = classes.join(of, "cls", "left").select("cls", F.coalesce("least", "rep").alias("least"), "rep", "rows").filter("rows > 1 or least <> rep").drop("rep")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    found = spread_join(named.filter(~alone), stage(of, "class-components"), "cls", "rows", n_rows, "left").select("id", "n", F.coalesce("least", "id").alias("component"))
    found = found.unionByName(named.filter(alone).select("id", "n", F.col("id").alias("component")))
    # documents that repeat an identifier with other texts join what their texts are in
    if named.groupBy("id").count().filter("id is not null and count > 1").limit(1).count():
        found = stage(found, "repeated")
        many = found.groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
        across = components(found.join(many, "id").select(F.col("component").alias("a"), F.col("x").alias("b")))
        found = found.join(across.withColumnRenamed("component", "least").withColumnRenamed("id", "component"), "component", "left").select("id", "n", F.coalesce("least", "component").alias("component"))
    return found


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that a link leads from to a smaller identifier; null identifiers stay."""
    found = stage(jaccard_components(docs, id_col, **options), "near")
    return without(docs, stage(found.filter("component < id").select("id").distinct(), "lost"), docs[id_col].cast("long"), "id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.8 of five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
many AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT doc_id, g FROM s SEMI JOIN many USING (g)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT doc_id, b FROM reach JOIN links ON other = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
