"""Scan of binary payloads by the text in them: printable runs, image metadata, extractors of the caller's own."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.text import printable_runs
from textward.operators import resilience, scan

MAX_BYTES = 32 << 20
TIMEOUT_S = 30.0
FOUND = "array<struct<text:string,channel:string>>"
EXTRACTED = f"struct<texts:{FOUND},error:string>"
# EXIF tags that hold text, by number; those of the second table are UTF-16LE bytes.
EXIF_TEXT = {0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013B: "Artist", 0x8298: "Copyright", 0x9286: "UserComment"}
EXIF_WIDE = {0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject"}
EXIF_FOLDER = 0x8769
EXIF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
USER_COMMENT_CODES = {b"ASCII\0\0\0": "utf-8", b"UNICODE\0": "utf-16", b"\0" * 8: "utf-8"}


def extract(files: DataFrame, content_col: str = "content", *, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """files with oversized and text, the printable runs ('' if there are none or the payload is over max_bytes)."""
    size = F.octet_length(content_col)
    out = files.withColumn("oversized", F.coalesce(size > max_bytes, F.lit(False)) if max_bytes else F.lit(False))
    return out.withColumn("text", F.when(F.col("oversized"), F.lit("")).otherwise(F.coalesce(printable_runs(F.col(content_col)), F.lit(""))))


def _tiff(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of a TIFF structure's text tags; entries that point outside it are passed over."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        n = min(struct.unpack_from(order + "H", data, at)[0], (len(data) - at - 2) // 12)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place, size = at + 10 + 12 * k, EXIF_SIZES.get(kind, 0) * count
            if tag == EXIF_FOLDER:
                todo.append(struct.unpack_from(order + "I", data, place)[0])
            if not size or tag not in EXIF_TEXT and tag not in EXIF_WIDE:
                continue
            if size > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            raw = data[place : place + size]
            if tag in EXIF_WIDE:
                text = raw.decode("utf-16-le", "ignore")
            elif EXIF_TEXT[tag] == "UserComment" and raw[:8] in USER_COMMENT_CODES:
                text = raw[8:].decode(USER_COMMENT_CODES[raw[:8]], "ignore")
            else:
                text = raw.decode("utf-8", "ignore")
            yield EXIF_WIDE.get(tag) or EXIF_TEXT[tag], text


def _png(data: bytes) -> Iterator[tuple[str, str]]:
    """(key, text) of a PNG's text chunks, and the tags of its EXIF chunk."""
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"eXIf":
            yield from _tiff(body)
        if kind not in (b"tEXt", b"zTXt", b"iTXt"):
            continue
        key, _, rest = body.partition(b"\0")
        code, packed = "latin-1", kind == b"zTXt"
        if packed:
            rest = rest[1:]
        elif kind == b"iTXt":
            code, packed = "utf-8", rest[:1] == b"\1"
            rest = rest[2:].split(b"\0", 2)[-1]
        if packed:
            try:
                rest = zlib.decompressobj().decompress(rest, MAX_BYTES)
            except zlib.error:
                continue
        yield key.decode("latin-1"), rest.decode(code, "ignore")


def _jpeg(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of a JPEG's comments and EXIF tags, up to the image itself."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + max(size, 2)
        if kind == 0xDA:
            return
        if kind == 0xFE:
            yield "comment", body.decode("utf-8", "ignore")
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            yield from _tiff(body[6:])


def metadata(content: bytes) -> str:
    """Lines `name: text` of an image's metadata (PNG text chunks, JPEG comments, EXIF of both and of TIFF); '' for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        found = _png(content)
    elif content[:2] == b"\xff\xd8":
        found = _jpeg(content)
    else:
        found = _tiff(content)
    lines = [(name, text.strip("\0").strip()) for name, text in found]
    return "\n".join(f"{name}: {text}" for name, text in lines if text)


@dataclass(frozen=True)
class Extractor:
    """A function of a payload's bytes and media type that returns a text, or a list of texts; nothing found is None, '' or []."""

    name: str
    fn: Callable[[bytes, str], object]
    channel: str = "ocr"
    timeout_s: float | None = TIMEOUT_S

    def __post_init__(self) -> None:
        if not self.name or self.timeout_s is not None and self.timeout_s <= 0:
            raise ValueError(f"no valid extractor: {self}")

    def column(self):
        """The extractor as a column function of (content, media type); an error is its row's, other rows go on."""
        fn, channel, seconds = self.fn, self.channel, self.timeout_s

        def answer(content: bytes, kind: str) -> dict:
            try:
                found = resilience.bounded(fn, content, kind, seconds=seconds)
                texts = [] if not found else [found] if isinstance(found, str) else [str(x) for x in found]
                return {"texts": [{"text": t, "channel": channel} for t in texts if t], "error": None}
            except Exception as e:  # noqa: BLE001 - an extractor's fault is a result
                return {"texts": [], "error": f"{type(e).__name__}: {e}"[:200]}

        @F.pandas_udf(EXTRACTED)
        def run(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([answer(c, k) for c, k in zip(contents, kinds)], columns=["texts", "error"])

        return run


METADATA = Extractor("exif", lambda content, _: metadata(content), "metadata")


def extract_all(files: DataFrame, extractors: tuple[Extractor, ...] = (METADATA,), *, content_col: str = "content", type_col: str | None = None, strings: bool = True, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """A row for each text of each payload, for `scan_texts`: files without their content, oversized, extractor, channel, text, error.

    The printable runs come first, unless strings is off. A payload in which nothing is found keeps one row of an empty
    text for each extractor; one over max_bytes isn't given to any. A null payload is an empty one. Names of extractors are unique.
    """
    if len({e.name for e in extractors} | {"binary_strings"}) <= len(extractors):
        raise ValueError("names of extractors are unique, and none is binary_strings")
    out = extract(files, content_col, max_bytes=max_bytes)
    kind = F.coalesce(F.col(type_col), F.lit("application/octet-stream")) if type_col else F.lit("application/octet-stream")
    content = F.when(F.col("oversized"), F.lit(b"")).otherwise(F.coalesce(F.col(content_col), F.lit(b"")))
    each = [F.array(F.struct(F.lit("binary_strings").alias("extractor"), F.lit("strings").alias("channel"), F.col("text"), F.lit(None).cast("string").alias("error")))] if strings else []
    for e in extractors:
        name = f"_{e.name}"
        out = out.withColumn(name, e.column()(content, kind))
        error = F.col(f"`{name}`.error").alias("error")
        row = lambda channel, text: F.struct(F.lit(e.name).alias("extractor"), channel.alias("channel"), text.alias("text"), error)  # noqa: B023, E731
        found = F.transform(F.col(f"`{name}`.texts"), lambda x: row(x["channel"], x["text"]))  # noqa: B023
        each.append(F.when(F.size(found) > 0, found).otherwise(F.array(row(F.lit(e.channel), F.lit("")))))
    kept = [F.col(f"`{c}`") for c in files.columns if c not in (content_col, "oversized", "text", "extractor", "channel", "error")]
    return out.select(*kept, "oversized", F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("_x")).select(*kept, "oversized", "_x.*")


def scan_texts(extracted: DataFrame, id_col: str = "path", *, text_col: str = "text", threshold: float = 0.6, **options) -> DataFrame:
    """(id_col, n_texts, risk, blocked): the worst of a payload's texts; extracted may hold several rows for each."""
    judged = scan.scan(extracted, text_col, threshold=threshold, tag="EXTERNAL_CONTENT", prefix="scan_", **options)
    big = F.col("oversized") if "oversized" in extracted.columns else F.lit(False)
    some = F.col(text_col) != ""
    risk = F.max(F.when(big, 1.0).when(some, F.col("scan_risk")).otherwise(0.0))
    return judged.groupBy(id_col).agg(F.count_if(some).alias("n_texts"), risk.alias("risk")).withColumn("blocked", F.col("risk") >= threshold)
