"""Token ids in Parquet: list columns with dictionary or delta encoding.

Documents are dealt into ranges of ids, sorted and encoded; a file holds a range in ascending
order.  Ids use dictionary pages (bit-packed, at most 17 bits an id) and fall back to delta encoding
where a dictionary grows too large; ids and positions use delta encoding. Row groups and pages are
small and page indexes are written, so a reader takes single columns or a few documents only.

A text is encoded word by word: each distinct run of characters between ASCII white space is
given to the tokenizers library once per worker and its ids are kept.  This equals encoding the
whole text where the tokenizer treats white space as a boundary, which `word_split` checks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm import words
from textward.llm.scratch import Scratch

END = 1
ROW_GROUP = 32 << 20
PAGE = 64 << 10
PAGE_ROWS = 1000
RANGE_BYTES = 128 << 20
#: Bytes of words' ids that a worker keeps between batches and tasks.
KEPT_BYTES = 64 << 20
_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
}


def word_split(spec: dict) -> bool:
    """Whether a tokenizer (its file's content) drops white space between words that it encodes apart."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    splits = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    level = [s for s in steps if s.get("type") == "ByteLevel"]
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not set(t["content"]) & set(" \t\n\v\f\r") for t in spec.get("added_tokens", []))
    return bool(splits) and all(not s.get("add_prefix_space") for s in level) and plain and spec.get("post_processor") is None


#: Fixed value: the splitting pattern whose pieces `_classes` can count in plain words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_JOINED = 1000


def _classes() -> np.ndarray:
    """Class of each byte of a plain word; 0: not plain (controls, apostrophe, "<", most of Unicode)."""
    c = np.zeros(256, np.uint8)
    c[33:127] = _SIGN
    c[[0x27, 0x3C]] = 0
    c[48:58] = _DIGIT
    c[65:91] = c[97:123] = _LETTER
    c[0x80:0xC0] = c[0xC3:0xC6] = _LETTER  # U+00C0 to U+017F
    return c


_CLASS = _classes()


def plain_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the number of letter runs, digits and sign runs in it; 0 if it isn't plain."""
    c = _CLASS[raw]
    odd = ((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))) | ((raw[:-1] == 0xC4) & (raw[1:] == 0xB0))  # U+00D7, U+00F7, U+0130
    c[:-1][odd] = 0
    bad = np.concatenate(([0], np.cumsum(c == 0)))
    edge = np.ones(len(c), bool)
    edge[1:] = (c[1:] != c[:-1]) | (c[1:] == _DIGIT)
    total = np.concatenate(([0], np.cumsum(edge)))
    pieces = total[ends] - total[starts] + ~edge[starts]
    return np.where(bad[ends] == bad[starts], pieces, 0)


class Encoder:
    """Ids of whole texts; distinct words are encoded once.

    Plain words are encoded many at a time, joined by spaces. Each piece of a word ends with the
    one id that closes a piece, so the closing ids tell the words' ids apart; should their number differ
    from that of the pieces, the words are encoded one by one.
    """

    def __init__(self, path: str, kept: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word, self.kept = word_split(spec), kept
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
        self.joins = bool(suffix) and split == [_PATTERN] and steps == ["NFC", "Replace", "Lowercase"]
        if self.joins:
            vocabulary = spec["model"]["vocab"]
            self.closes = np.zeros(max(self.tokenizer.get_vocab_size(), max(vocabulary.values()) + 1), bool)
            self.closes[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.used = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep the words that a later batch had again, if they are the lesser part; most words occur once."""
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > len(self.keys):
            return self.clear()
        size = self.size[keep].astype(np.int64)
        before = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.at[keep] - before, size) + np.arange(size.sum())]
        self.keys, self.at, self.size, self.used = self.keys[keep], before, self.size[keep], np.zeros(len(keep), bool)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([k for x in got for k in x], np.int32), np.array([len(x) for x in got], np.int64)

    def _joined(self, texts: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has."""
        starts = range(0, len(texts), _JOINED)
        got = self.tokenizer.encode_batch_fast([" ".join(texts[a : a + _JOINED]) for a in starts], add_special_tokens=False)
        ids, sizes = [], []
        for a, e in zip(starts, got, strict=True):
            some = np.array(e.ids, np.int32)
            last = np.cumsum(pieces[a : a + _JOINED]) - 1
            closing = np.flatnonzero(self.closes[some])
            if len(closing) == last[-1] + 1:
                ids.append(some)
                sizes.append(np.diff(closing[last], prepend=-1))
            else:
                one, size = self._one_by_one(texts[a : a + _JOINED])
                ids.append(one)
                sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, texts: list[str], pieces: np.ndarray) -> None:
        plain = np.flatnonzero(pieces) if self.joins else np.zeros(0, int)
        other = np.flatnonzero(pieces == 0) if self.joins else np.arange(len(texts))
        for some, encode in ((plain, lambda t: self._joined(t, pieces[plain])), (other, self._one_by_one)):
            if len(some):
                ids, size = encode([texts[i] for i in some])
                at = len(self.ids) + np.cumsum(size) - size
                self.ids = np.concatenate([self.ids, ids])
                where = np.searchsorted(self.keys, keys[some])
                self.keys = np.insert(self.keys, where, keys[some])
                self.at = np.insert(self.at, where, at)
                self.size = np.insert(self.size, where, size)
                self.used = np.insert(self.used, where, False)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end, and the offset of each text in them."""
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)
            each = [np.array([*e.ids, end], np.int32) for e in got]
            return np.concatenate(each) if each else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        raw, offs = words.utf8(column)
        if self.joins:  # plain words count alike in either case
            hashes, rows, starts, ends = words.word_hashes(raw, offs, spans=True)
            pieces = plain_words(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
            other = np.flatnonzero(pieces == 0)
            exact = [words.hash_spans(raw[a:b], np.array([0]), np.array([b - a]), words.TABLES.exact)[0] for a, b in zip(starts[other], ends[other], strict=True)]
            hashes[other] = words.mix(np.array(exact, np.uint64) + np.uint64(1))
        else:
            hashes, rows, starts, ends = words.word_hashes(raw, offs, spans=True, code=words.TABLES.exact)
            pieces = np.zeros(len(starts), np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(x.nbytes for x in (self.keys, self.at, self.size, self.ids)) > self.kept:
            self._forget()
        k = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = k < len(self.keys)
        new[inside] = self.keys[k[inside]] != distinct[inside]
        self.used[k[~new]] = True
        if new.any():
            data, at = raw.tobytes(), first[new]
            self._learn(distinct[new], [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pieces[at])
        k = np.searchsorted(self.keys, distinct)[inverse]
        at, size = self.at[k], self.size[k].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(size)))
        counts = before[rows[1:]] - before[rows[:-1]]
        out_offs = np.concatenate(([0], np.cumsum(counts + 1)))
        out = np.full(int(out_offs[-1]), end, np.int32)
        body = np.ones(len(out), bool)
        body[out_offs[1:] - 1] = False
        out[body] = self.ids[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        return out, out_offs


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; what it has learned serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _ranges(docs: DataFrame) -> int:
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, size // RANGE_BYTES)  # at the top: unknown


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, order: list[Column] | None = None) -> None:
    """Write (part, doc_id, local_start, n_tokens, ids) in ascending order of id_col, nulls first, or of `order`.

    A null or empty text has the end id alone. Rows of equal id stand in order of text; repeated rows are each
    written. Columns of other names aren't read.
    local_start counts the ids before a document in its part; parts are ranges in ascending order.
    tokenizer: path of a file of the tokenizers library that every executor can open.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(f"at{k}") for k, c in enumerate(order or [])])
    by = [f"at{k}" for k in range(len(order or []))] or ["doc_id"]
    dealt = source.repartitionByRange(_ranges(docs), *by).sortWithinPartitions(*by, "doc_id", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in words.slices(batch.column("text")):
                ids, offs = coder.encode(batch.column("text").slice(a, b - a), end)
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), batch.column("doc_id").slice(a, b - a), pa.array(offs[:-1] + before), pa.array(np.diff(offs)), lists],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                before += int(offs[-1])

    out = dealt.mapInArrow(words.thrifty(run), "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    out.write.options(**_OPTIONS).parquet(path)


SCHEMA = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)


def read(spark, path: str) -> DataFrame:
    """The written documents, with `start` (ids of all documents before). Columns and rows that
    a query doesn't need aren't read: filters on doc_id reach row groups and pages."""
    table = spark.read.schema(SCHEMA).parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one small row for each part
    base = sums.select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    return table.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offs, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        crc = [ids_crc32(flat[offs[i] : offs[i + 1]]) for i in range(len(ids))]
        size = np.diff(offs).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a table from `read`."""
    return table.select("doc_id", "start", "ids").mapInArrow(words.thrifty(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> DataFrame:
    """Write docs into the shared folder, read the files back and return their digest."""
    path = Scratch(docs.sparkSession, "tokens").path("ids")
    write(docs, path, tokenizer, id_col=id_col, text_col=text_col, order=order)
    return digest(read(docs.sparkSession, path))
