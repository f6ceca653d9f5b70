"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Each record is a gzip member of its own. Of records with equal payloads the one with the largest
page id holds the payload (response), the others refer to it (revisit). The reader cuts
archives into byte ranges; a task looks for gzip's magic bytes, takes a candidate for a member if it
inflates to a WARC header, and reads the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import files, words
from textward.llm.scratch import Scratch

MAGIC = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
#: Smaller payloads are never replaced by a reference.
MIN_PAYLOAD = 0
#: Copies of the table of repeated digests that rows are dealt over, so that a frequent payload fills no task.
SALTS = 16
LEVEL = 6
_READ = 1 << 18
_WHEN = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:textward:page:{'none' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    tail = (name or "").removesuffix(">").rpartition(":")[2]
    return None if tail in ("", "none") else int(tail)


def member(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, level: int = LEVEL) -> bytes:
    """A record as a gzip member: a response with its payload, or a revisit without (payload None)."""
    body = _HTTP % size + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_WHEN}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if payload is None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def plan(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) of pages with columns page_id, url, html.

    responses: page_id, url, html, digest. revisits: page_id, url, digest, size, refers_to.
    Rows that repeat the largest id of a payload are all responses; so are all rows of a
    payload that has no page id, while others without an id refer to the one that has.
    """
    text = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    small = full.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("size"))
    groups = small.where(F.col("size") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    several = groups.where("n > 1 and holder is not null").select("digest", "holder")
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    revisits = small.withColumn("salt", salt).join(salted, ["digest", "salt"]).where("page_id is null or page_id <> holder")
    revisits = revisits.select("page_id", "url", "digest", "size", F.col("holder").alias("refers_to"))
    # ids that only refer don't carry their payload any further
    gone = revisits.where("page_id is not null").select("page_id", "digest").distinct()
    kept = full.where("page_id is not null").join(gone, ["page_id", "digest"], "left_anti")
    nameless = full.where("page_id is null").join(several, "digest", "left_anti")
    return kept.unionByName(nameless), revisits


def write(pages: DataFrame, root: str, *, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write archives under root; lazily returns (path, bytes, records), a row for each archive.

    Null html is an empty payload. Archives are named by the attempt that wrote them, and only those of attempts
    that succeeded are listed: a late or repeated attempt, whose rows may come in another order, replaces none.
    Repeated rows are each written; columns of other names aren't read.
    """
    responses, revisits = plan(pages, min_payload)
    size = F.octet_length("html").cast("long")
    both = responses.select("page_id", "url", "digest", size.alias("size"), "html", F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select("page_id", "url", "digest", "size", F.lit(None).cast("string").alias("html"), "refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        chunks: list[bytes] = []
        held = records = 0

        def close() -> pa.RecordBatch:
            nonlocal number, chunks, held, records
            path = f"{root}/part-{task.partitionId():05d}-{number:05d}-{task.taskAttemptId()}.warc.gz"
            files.publish(path, chunks)
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([held], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])
            number, chunks, held, records = number + 1, [], 0, 0
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, digest, size, html, refers = (batch.column(j)[k].as_py() for j in range(6))
                chunks.append(member(page, url, None if html is None else html.encode(), digest32(digest), size, refers, level))
                held += len(chunks[-1])
                records += 1
                if held >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return both.mapInArrow(words.thrifty(run), "path string, bytes long, records long")


class _Input:
    """Random access to a file's bytes, read ahead."""

    def __init__(self, uri: str) -> None:
        system, path = files.resolve(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, n: int = _READ) -> bytes:
        n = min(n, self.size - offset)
        return self.file.read_at(n, offset) if n > 0 else b""


def _inflate(source: _Input, at: int, header_only: bool) -> tuple[bytes, int] | None:
    """The member at an offset, inflated, and the offset after it; None if it's none or no WARC record."""
    inflate, out, here = zlib.decompressobj(31), bytearray(), at
    while not inflate.eof:
        chunk = source.at(here)
        if not chunk:
            return None
        try:
            out += inflate.decompress(chunk)
        except zlib.error:
            return None
        here += len(chunk) - len(inflate.unused_data)
        if len(out) >= 7 and not out.startswith(b"WARC/1."):
            return None
        if header_only and (b"\r\n\r\n" in out or len(out) > 1 << 20):
            return (bytes(out), here) if b"\r\n\r\n" in out else None
    return (bytes(out), here) if out.startswith(b"WARC/1.") and b"\r\n\r\n" in out else None


def first_record(source: _Input, start: int, end: int) -> int | None:
    """Offset in [start, end) of the first member that is a WARC record."""
    at = start
    while at < end:
        chunk = source.at(at, _READ + len(MAGIC) - 1)
        k = chunk.find(MAGIC)
        while k >= 0 and at + k < end:
            if _inflate(source, at + k, True):
                return at + k
            k = chunk.find(MAGIC, k + 1)
        at += _READ
    return None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and content of a record; None without those that every record has."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or not headers.get("warc-type") or not headers.get("warc-record-id"):
        return None
    return headers, rest[: int(size)]


def records(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive that start in [start, end), whole even where they end beyond."""
    source = _Input(uri)
    at = first_record(source, start, end)
    while at is not None and at < end:
        got = _inflate(source, at, False)
        record = got and parse(got[0])
        if not record:  # damaged, or bytes between members: look for the next one
            at = first_record(source, at + 1, end)
            continue
        yield record
        at = got[1]
        if at < min(end, source.size) and source.at(at, len(MAGIC)) != MAGIC:
            at = first_record(source, at, end)


def read(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of archives (path, bytes).

    payload is null for revisits; size and digest are then those the record tells of the full payload.
    A response whose payload doesn't have the digest it tells fails the read.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = archives.select("path", F.explode(starts).alias("start"))
    session = archives.sparkSession
    ranges = ranges.repartition(max(1, min(ranges.count(), 4 * session.sparkContext.defaultParallelism * 64)))
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                for head, content in records(path, start, start + split_bytes):
                    told = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        payload = content.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if told and told != digest:
                            raise ValueError(f"{path}: payload of {head['warc-record-id']} has digest {digest}, not {told}")
                    else:
                        payload, size, digest = None, int(head.get("x-payload-length", 0)), told
                    rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _number(head.get("warc-refers-to")), payload, size, digest))
                    held += size
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return ranges.mapInArrow(words.thrifty(run), "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archives_in(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of the archives under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root).select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write pages into the shared folder, read the archives back, and return
    (page_id, payload_bytes, payload_digest, record_type, refers_to) for every row."""
    scratch = Scratch(pages.sparkSession, "warc")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    written = scratch.keep(write(source, scratch.path("archives"), min_payload=min_payload), "written")
    return read(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
