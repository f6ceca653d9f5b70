"""Languages of words and texts.

A word's letters name its script, and the script the languages that can be meant. Each of
those gets a score, the log probability of the word's character n-grams (hashed to BUCKETS
counters a language). Viterbi's algorithm then finds the sequence of languages with the
greatest sum of scores less a penalty for each switch: the spans of a mixed text.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import words
from textward.llm.scratch import bounded

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
#: At most about this many documents of each language are learned from (drawn by a hash of the id).
FIT_ROWS = 3000
SWITCH = 12.0
#: A language is meant by a script that at least this share of its words are written in.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: First code point of each range, with its script.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0F00, "Tibetan"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({s for _, s in _RANGES})
_FIRST = [a for a, _ in _RANGES]
_NUMBER = [SCRIPTS.index(s) for _, s in _RANGES]
LATIN = SCRIPTS.index("Latin")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def script(word: str) -> int:
    """Number of the script of the word's first letter; -1 without letters."""
    for c in word:
        if c.isalpha():
            return _NUMBER[bisect.bisect_right(_FIRST, ord(c)) - 1]
    return -1


class Words:
    """The distinct words of a batch: script and hashed n-grams of each."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        n = len(starts)
        # every word with a space on both sides, lower-cased
        offs = np.zeros(n + 1, np.int64)
        np.cumsum(size + 2, out=offs[1:])
        text = np.full(int(offs[-1]), 32, np.uint8)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        source = raw[np.repeat(starts, size) + at]
        text[np.repeat(offs[:-1] + 1, size) + at] = words.TABLES.lower[source]
        word = np.repeat(np.arange(n), size)
        ascii_letter = np.bincount(word, _LETTER[source], n) > 0
        other = np.bincount(word, source >= 128, n) > 0
        self.script = np.where(ascii_letter, LATIN, -1)
        for i in np.flatnonzero(other):
            self.script[i] = script(raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
        code = words.TABLES.code[text]
        buckets, owners = [], []
        owner = np.repeat(np.arange(n), size + 2)
        gram = np.zeros(len(text), np.uint64)
        last = np.repeat(offs[1:], size + 2) - np.arange(len(text))  # bytes up to the word's end
        for k in range(max(GRAMS)):
            m = len(text) - k
            gram = gram[:m] * np.uint64(0xD6E8FEB86659FD93) + code[k:]
            if k + 1 in GRAMS:
                inside = last[:m] > k
                buckets.append((words.mix(gram[inside] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32))
                owners.append(owner[:m][inside])
        whole = words.hash_spans(text, offs[:-1], offs[1:]) if n else np.zeros(0, np.uint64)
        buckets.append((whole >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(np.arange(n))
        self.bucket, self.owner, self.n = np.concatenate(buckets), np.concatenate(owners), n

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word, the sum of the table's rows of its n-grams; 0 for words without letters."""
        out = np.stack([np.bincount(self.owner, table[self.bucket, j], self.n) for j in range(table.shape[1])], axis=1)
        out[self.script < 0] = 0
        return out.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # [BUCKETS, languages]
    meant: np.ndarray  # [scripts, languages]: which languages a script can mean

    def emissions(self, found: Words) -> np.ndarray:
        out = found.sums(self.logp)
        can = self.meant[found.script]
        out[~can & (found.script >= 0)[:, None]] -= 1e4
        return out


def viterbi(scores: np.ndarray, rows: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each position; rows delimit the sequences, which advance side by side."""
    count = np.diff(rows)
    order = np.argsort(-count, kind="stable")
    count, first = count[order], rows[:-1][order]
    longest = int(count[0]) if len(count) else 0
    out = np.zeros(len(scores), np.int16)
    n_labels = scores.shape[1]
    if not longest or n_labels == 1:
        return out
    active = np.searchsorted(-count, -np.arange(longest), "left")  # sequences longer than t
    now = scores[first[: active[0]]]
    tops, moved = [], []
    final = np.zeros(len(count), np.int16)
    for t in range(1, longest):
        n = active[t]
        if n < len(now):
            final[n : len(now)] = now[n:].argmax(axis=1)
            now = now[:n]
        top = now.argmax(axis=1)
        best = now[np.arange(n), top][:, None] - switch
        tops.append(top.astype(np.int16))
        moved.append(best > now)
        now = np.maximum(now, best) + scores[first[:n] + t]
    final[: len(now)] = now.argmax(axis=1)
    label = final
    for t in range(longest - 1, 0, -1):
        n = active[t]
        out[first[:n] + t] = label[:n]
        label[:n] = np.where(moved[t - 1][np.arange(n), label[:n]], tops[t - 1], label[:n])
    n = active[0]
    out[first[:n]] = label[:n]
    return out


def _distinct(column: pa.Array):
    raw, offs = words.utf8(column)
    hashes, rows, starts, ends = words.word_hashes(raw, offs, spans=True)
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(raw, starts[at], ends[at]), inverse, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, kind, key, n): n-grams by bucket (kind 0) and words by script (kind 1)."""
    total: dict[str, np.ndarray] = {}
    by_script: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b in words.slices(batch.column("text")):
            langs = batch.column("lang").slice(a, b - a).to_pylist()
            found, inverse, rows = _distinct(batch.column("text").slice(a, b - a))
            of = np.repeat(np.arange(b - a), np.diff(rows))
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])[of]
                uses = np.bincount(inverse[mine], minlength=found.n).astype(float)
                uses[found.script < 0] = 0
                total.setdefault(lang, np.zeros(BUCKETS))
                total[lang] += np.bincount(found.bucket, uses[found.owner], BUCKETS)
                by_script.setdefault(lang, np.zeros(len(SCRIPTS)))
                by_script[lang] += np.bincount(np.maximum(found.script, 0), uses, len(SCRIPTS))
    for kind, table in enumerate((total, by_script)):
        for lang, n in table.items():
            key = np.flatnonzero(n)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(np.full(len(key), kind), pa.int32()), pa.array(key.astype(np.int32)), pa.array(n[key].astype(np.int64))], names=["lang", "kind", "key", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from docs with a non-null lang_col: about fit_rows of each language, drawn by a hash of the id.

    What comes to the driver are at most BUCKETS counters a language.
    """
    bounded(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.lit(1 << 30)
    for lang, n in sizes.items():
        if n > fit_rows:
            part = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * fit_rows / n))).otherwise(part)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part).select("lang", "text")
    counts = drawn.mapInArrow(words.thrifty(_count), "lang string, kind int, key int, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    number = counts["lang"].map({x: i for i, x in enumerate(languages)})
    table = np.zeros((BUCKETS, max(len(languages), 1)))
    by_script = np.zeros((len(SCRIPTS), max(len(languages), 1)))
    for kind, into in ((0, table), (1, by_script)):
        mine = counts["kind"] == kind
        into[counts["key"][mine], number[mine].astype(int)] = counts["n"][mine]
    logp = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * BUCKETS)
    meant = by_script >= SCRIPT_SHARE * np.maximum(by_script.sum(axis=0), 1)
    meant[~meant.any(axis=1)] = True
    return Model(languages, (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32), meant)


def detect(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id_col, lang_pred, score, spans) for every row of docs.

    spans: array of (lang, first, n), runs of words of one language; words without letters go
    with their surroundings.  lang_pred has the most words with letters (the first in order
    of name among equals); score is its share of them.  Null texts and texts without a letter,
    or a model without languages, give 'und', 0.0 and no spans.
    """
    bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        last = len(m.languages)
        for batch in batches:
            text = batch.column("text")
            for a, b in words.slices(text, 1 << 23):
                found, inverse, rows = _distinct(text.slice(a, b - a))
                n = b - a
                lettered = found.script[inverse] >= 0
                of = np.repeat(np.arange(n), np.diff(rows))
                any_letter = np.bincount(of, lettered, n) > 0 if last else np.zeros(n, bool)
                label = viterbi(m.emissions(found)[inverse], rows, switch) if last else np.zeros(len(inverse), np.int16)
                votes = np.bincount(of * max(last, 1) + label, lettered, n * max(last, 1)).reshape(n, -1)
                best = np.where(any_letter, votes.argmax(axis=1), last)
                share = np.where(any_letter, votes.max(axis=1) / np.maximum(votes.sum(axis=1), 1), 0.0)
                new = np.ones(len(label), bool)
                new[1:] = label[1:] != label[:-1]
                new[rows[:-1][rows[:-1] < len(label)]] = True
                new &= any_letter[of]
                cut = np.flatnonzero(new)
                owner = of[cut]
                end = np.append(cut[1:], len(label))
                end = np.minimum(end, rows[owner + 1])
                spans = pa.StructArray.from_arrays([pa.array(names[label[cut]], pa.string()), pa.array(cut - rows[owner]), pa.array(end - cut)], fields=list(span.value_type))
                offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, n), pa.array(names[best], pa.string()), pa.array(share), pa.ListArray.from_arrays(offsets, spans, type=span)], names=["id", "lang_pred", "score", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = source.mapInArrow(words.thrifty(run), f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,first:bigint,n:bigint>>")
    return out.withColumnRenamed("id", id_col)
