"""WARC archives with an index: written by tasks, read back by coalesced byte ranges.

Writing: digests are taken in the JVM; of equal payloads of at least `least_bytes` the largest id becomes a response and
the others revisit it (one aggregated row per digest, joined on narrow rows; of the html itself only what a filter picks as
a possible revisit meets its flag in a join). Each task appends gzip members, one per record, to archives of up to `archive_bytes` in the
shared folder. A task that runs twice writes archives of another name; the index holds only those of the attempt that
Spark committed, so lost executors leave at worst files that nobody reads.

Index first: a row per record with archive, offset, length, url, digest, type and id, kept as Parquet. Reading starts
from selected index rows: they are dealt by archive and stretch of `range_bytes` to a task per as many bytes of records, sorted by offset, and neighbours whose
gap is at most `gap_bytes` are read with one call. Every payload read is checked against its record's digest.

Defined results: null html is an empty payload; a null url leaves out WARC-Target-URI; control characters and blanks in
urls are percent-encoded; a null id gives an id header of "null" and may be neither target nor source of a revisit;
rows that repeat an id get a record each (all responses, where the id is the largest of equal payloads); an empty table
gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.common import fresh_path, key_filter, may_contain, stage, table

INDEX = "id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long, payload_bytes long"
READ = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> tuple[bytes, str]:
    """One record's bytes before compression, and its payload's SHA-1 in hex."""
    sha1 = hashlib.sha1(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if id is None else id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(sha1.digest()).decode())
    head.append(f"X-Payload-Length: {len(payload)}")
    block = HTTP + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        block = HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha1.hexdigest()


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = head["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
    number = lambda x: None if x is None or "null" in x else int(x.rpartition(":")[2].rstrip(">"))
    return {
        "id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": number(head.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, archive_bytes: int = 256 << 20, path: str | None = None) -> DataFrame:
    """Write an archive record per row of pages; gives the index, a table in the shared folder."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    raw = F.encode("html", "UTF-8")
    # two digests and the length name a payload
    named = rows.select("id", F.octet_length("html").alias("size"), F.unhex(F.sha1(raw)).alias("sha1"), F.xxhash64(raw).alias("name"))
    named = named.filter((F.col("size") >= least_bytes) & F.col("id").isNotNull())
    first = named.groupBy("sha1", "size", "name").agg(F.max("id").alias("target"), F.count("*").alias("n")).filter("n > 1")
    linked = named.join(first, ["sha1", "size", "name"]).filter("id <> target").select("id", "target", "sha1")
    revisits = stage(linked.groupBy("id", "sha1").agg(F.max("target").alias("target")), "revisits")  # repeated ids meet once
    # html itself meets its flag only where a filter of bounded size says that it may have one
    named = F.struct("id", "sha1")
    bits = F.broadcast(stage(key_filter(revisits.select(named.alias("row")), "row"), "revisit-filter"))
    keyed = rows.withColumn("sha1", F.unhex(F.sha1(raw))).crossJoin(bits).withColumn("may", may_contain(F.col("bits"), named)).drop("bits")
    met = keyed.filter("may").join(revisits, ["id", "sha1"], "left").select("id", "url", "html", "target")
    marked = met.unionByName(keyed.filter("not may").select("id", "url", "html", F.lit(None).cast("long").alias("target")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _fs(path)
        store.create_dir(base, recursive=True)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                found = []
                for id_, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = html.encode()
                    data, digest = record(id_, url, payload, refers)
                    squeezer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = squeezer.compress(data) + squeezer.flush()
                    if out is None or at + len(data) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    out.write(data)
                    found.append((id_, name, at, len(data), url, digest, "response" if refers is None else "revisit", refers, len(payload)))
                    at += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in found], schema=_ARROW)
        finally:
            if out is not None:
                out.close()

    return stage(marked.mapInArrow(kernels.trimmed(write), INDEX), "warc-index")


_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])
_ARROW_READ = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ.split(", "))])


def runs(rows: list[tuple[int, int]], gap_bytes: int, most: int) -> list[tuple[int, int]]:
    """Sorted (offset, length) rows as [first, last) index ranges, each to be read with one call of about `most` bytes."""
    found, first = [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] - sum(rows[i - 1]) > gap_bytes or sum(rows[i]) - rows[first][0] > most:
            found.append((first, i))
            first = i
    return found if rows else []


def read_warc(index: DataFrame, scheme_from: str, range_bytes: int = 16 << 20, gap_bytes: int = 64 << 10, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows. scheme_from: a URI of the archives' file system."""
    stretch = F.floor(F.col("offset") / range_bytes)
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-int(size) // range_bytes), index.sparkSession.sparkContext.defaultParallelism)  # not merged by the index's own few bytes
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _fs(scheme_from)[0]
        for batch in batches:
            part = batch.to_pandas()
            for archive, rows in part.groupby("archive", sort=False):
                spans = list(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True))
                with store.open_input_file(archive) as file:
                    for first, last in runs(spans, gap_bytes, range_bytes):
                        start = spans[first][0]
                        block = file.read_at(sum(spans[last - 1]) - start, start)
                        found = [parse(zlib.decompress(block[o - start : o - start + n], 31)) for o, n in spans[first:last]]
                        if not with_payload:
                            found = [x | {"payload": None} for x in found]
                        yield pa.RecordBatch.from_pylist(found, schema=_ARROW_READ)

    return dealt.mapInArrow(kernels.trimmed(read), READ)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, then read every record back."""
    index = write_warc(table(spark, sf_dir, "pages"))
    # the records' own fields are returned, not the index's
    back = read_warc(index, fresh_path(spark, "warc"), with_payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest, max(page_id) OVER (PARTITION BY raw) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN payload_bytes < 1000 OR last = page_id THEN NULL ELSE last END AS refers_to
FROM d
"""
