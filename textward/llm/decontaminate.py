"""Test items found in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased, so
that punctuation and case don't hide a copy.  The score is the alignment's share of the best possible:
1.0 for a whole verbatim copy.

An item's seeds are its pairs of neighbouring words, without some that are frequent by the corpus's own word
frequencies (under independence, so a passage that has leaked into many documents stays rare). An alignment
of m words that scores at least MIN_SCORE = 0.6 has k matches and at most 2k - 1.2m edits, so
of the k - 1 steps between matches 1.2m - k - 1 or more are without an edit: at least 0.2m - 1
pairs stand in the document unbroken. Half of that number are left out, the most frequent ones, and a
document with the other half of them is aligned: no copy at or above the score is lost. This holds from
six words on; shorter items are searched for as whole sequences. Long items are also found by an excerpt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import words
from textward.llm.scratch import bounded

SEED = 2
MIN_SCORE = 0.6
#: Shorter items are found only as they stand: one edit leaves too little of them.
WHOLE = 6
#: An alignment worth so many matched words tells, however long its item is.
EXCERPT = 40
MIN_ITEM_WORDS = 1
#: Bytes of items that are sent to every task at once, with about six times as much for their seeds; larger benchmarks go block by block.
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_FILTER_BITS = 22


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of item in window, and the window position after its end."""
    n = len(window)
    ramp = -GAP * np.arange(1, n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.maximum(np.where(window == w, MATCH, MISMATCH) + row[:-1], row[1:] + GAP)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + ramp) - ramp
        top = int(step.argmax()) if n else 0
        if n and step[top] > best:
            best, end = int(step[top]), top + 1
        row = np.concatenate(([0], step))
    return best, end


@dataclass
class Items:
    """Test items of one block: their words, the places of their seeds, and the sequences of short ones."""

    ids: list[int]
    words: list[np.ndarray]
    least: np.ndarray  # alignment score that an item needs
    need: np.ndarray  # seeds that an alignment of it has at least
    seeds: np.ndarray  # sorted
    first: np.ndarray  # offset of each distinct seed in item/at
    item: np.ndarray
    at: np.ndarray
    near: np.ndarray  # filter on the top bits of a hash
    whole: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hashes of sequences, sorted, and their items

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams of seeds, and the number of the seed at each."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.near[grams >> np.uint64(64 - _FILTER_BITS)])
        k = np.minimum(np.searchsorted(self.seeds, grams[maybe]), len(self.seeds) - 1)
        ok = self.seeds[k] == grams[maybe]
        return maybe[ok], k[ok]

    def postings(self, places: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in places, item, place in the item) of each item that has a seed found."""
        size = self.first[kinds + 1] - self.first[kinds]
        k = np.repeat(self.first[kinds], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(np.arange(len(places)), size), self.item[k], self.at[k]


def _filter(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[values >> np.uint64(64 - _FILTER_BITS)] = True
    return out


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = words.utf8(column)
    return words.word_hashes(raw, offs, inside=words.TABLES.alnum)


def _frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, int]:
    """How often each word of the vocabulary occurs in all texts; words and texts in all."""
    sent = texts.sparkSession.sparkContext.broadcast((vocabulary, _filter(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, near = sent.value
        counts = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for a, b in words.slices(batch.column("text")):
                h, _ = _hashes(batch.column("text").slice(a, b - a))
                counts[-2] += len(h)
                h = h[near[h >> np.uint64(64 - _FILTER_BITS)]]
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                counts[: len(known)] += np.bincount(k[known[k] == h], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["k", "n"])

    total = np.zeros(len(vocabulary) + 2, np.int64)
    for k, n in texts.mapInArrow(words.thrifty(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        total[k] = n
    return total[:-2], int(total[-2]), int(total[-1])


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows of items in blocks that are small enough to broadcast; repeats of a row count once."""
    items = items.where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first().b or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield sorted(rows)


def least_score(m: int, min_score: float) -> float:
    """The alignment score from which on an item of m words is found; short items have to stand whole."""
    return MATCH * m if m < WHOLE else MATCH * min(min_score * m, EXCERPT)


def unbroken(m: int, min_score: float) -> int:
    """How many pairs of neighbouring words of an item of m such an alignment has at least, unbroken."""
    return max(1, min(math.ceil((MATCH * min_score - 1) * m - 1 - 1e-9), EXCERPT - 1))


def prepare(rows: list, texts: DataFrame, min_score: float, min_item_words: int) -> Items | None:
    """Items of one block with seeds that are rare in texts; None if no item is long enough."""
    h, at = _hashes(pa.array([r.text for r in rows], pa.string()))
    kept = [i for i in range(len(rows)) if at[i + 1] - at[i] >= max(min_item_words, 1)]
    if not kept:
        return None
    own = [h[at[i] : at[i + 1]] for i in kept]
    vocabulary = np.unique(np.concatenate(own))
    counts, n_words, _ = _frequencies(texts, vocabulary)
    log_share = np.log((counts + 0.5) / (n_words + 0.5 * (len(vocabulary) + 1)))
    seeds, of, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    need = np.zeros(len(own), np.int64)
    whole: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(own):
        if len(w) < WHOLE:
            whole.setdefault(len(w), []).append((int(words.combine(w, len(w))[0]), i))
            continue
        least = unbroken(len(w), min_score)
        share = log_share[np.searchsorted(vocabulary, w)]
        places = np.sort(np.argsort(share[1:] + share[:-1], kind="stable")[: len(w) - 1 - least // 2])
        need[i] = least - least // 2
        seeds.append(words.combine(w, SEED)[places])
        of.append(np.full(len(places), i, np.int32))
        where.append(places.astype(np.int32))
    seeds, of, where = map(np.concatenate, (seeds, of, where))
    order = np.lexsort((where, of, seeds))
    distinct, first = np.unique(seeds[order], return_index=True)
    short = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v), strict=True), (np.uint64, np.int64), strict=True)) for n, v in whole.items()}
    least = np.array([least_score(len(w), min_score) for w in own])
    return Items([rows[i].item_id for i in kept], own, least, need, distinct, np.append(first, len(order)), of[order], where[order], _filter(distinct), short)


def match(doc: np.ndarray, starts: np.ndarray, w: np.ndarray, least: float, need: int) -> tuple[float, int, int] | None:
    """(score, first word, words) of the best alignment of an item in doc, the first of equal ones; None below `least`.

    starts: where the item would begin by each seed found, ascending.
    """
    m = len(w)
    best = (0, 0, 0)
    vocabulary, own = np.unique(w, return_counts=True)
    for near in np.split(starts, np.flatnonzero(np.diff(starts) > 3 * m) + 1):
        if len(near) < need:
            continue
        low = max(0, int(near[0]) - m)
        window = doc[low : max(0, int(near[-1]) + 2 * m)]
        k = np.minimum(np.searchsorted(vocabulary, window), len(vocabulary) - 1)
        here = np.bincount(k[vocabulary[k] == window], minlength=len(vocabulary))
        if MATCH * np.minimum(here, own).sum() < least:  # no alignment can reach the score
            continue
        score, end = align(w, window)
        if score > best[0]:
            _, back = align(w[::-1], window[:end][::-1])
            best = (score, low + end - back, back)
    return (best[0] / (MATCH * m), *best[1:]) if best[0] >= least - 1e-9 else None


def _whole(items: Items, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
    """Short items: (document, match) for the first place of each."""
    for n, (hashes, which) in items.whole.items():
        at, offs = words.windows(rows, n)
        if not len(at):
            continue
        grams = words.combine(h, n)[at]
        low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
        found = np.flatnonzero(high > low)
        doc = np.searchsorted(offs, found, "right") - 1
        _, first = np.unique(np.column_stack([doc, low[found]]), axis=0, return_index=True)
        for f in first:
            place, d = int(found[f]), int(doc[f])
            for k in range(int(low[place]), int(high[place])):
                yield d, (int(which[k]), 1.0, int(at[place] - rows[d]), n)


def _found(items: Items, text: pa.Array) -> list[list[tuple[int, float, int, int]]]:
    """For each text (item number, score, first word, words) of the items in it."""
    out: list[list] = []
    for a, b in words.slices(text):
        h, rows = _hashes(text.slice(a, b - a))
        here: list[list] = [[] for _ in range(b - a)]
        for d, found in _whole(items, h, rows):
            here[d].append(found)
        places, kinds = items.find(words.combine(h, SEED))
        of = np.searchsorted(rows, places, "right") - 1
        inside = places + SEED <= rows[of + 1]
        which, item, at = items.postings(places[inside], kinds[inside])
        doc, start = of[inside][which], places[inside][which] - at
        key = doc * len(items.ids) + item
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)
        enough = np.diff(cuts) >= items.need[key[cuts[:-1]] % len(items.ids)] if len(key) else np.zeros(0, bool)
        for k in np.flatnonzero(enough):
            i, j = divmod(int(key[cuts[k]]), len(items.ids))
            got = match(h[rows[i] : rows[i + 1]], start[cuts[k] : cuts[k + 1]] - rows[i], items.words[j], items.least[j], int(items.need[j]))
            if got:
                here[i].append((j, *got))
        out += here
    return out


def _source(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_item_words: int = MIN_ITEM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_id, score, first_word, n_words): a row for each document and item found in it.

    first_word and n_words tell where the best alignment lies, the first of equal ones, in words from 0.
    Items under WHOLE words are found where they stand whole; longer ones from min_score (0.6 or more) or EXCERPT words
    on. Null texts hold nothing; items without id, text or words, or with fewer than min_item_words, name nothing.
    A document that stands twice gives its rows twice, an item that does gives them once; different
    texts of one item id are each looked for. Columns of other names are not read. No rows without items.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, score double, first_word long, n_words long"
    out = None
    for rows in _blocks(_source(benchmark, item_id, item_text), block_bytes):
        items = prepare(rows, texts.select("text"), min_score, min_item_words)
        if items is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            it = sent.value
            for batch in batches:
                found = _found(it, batch.column("text"))
                flat = [(i, *m) for i, ms in enumerate(found) for m in ms]
                if flat:
                    row, item, score, first, n = zip(*flat, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row)), pa.array([it.ids[k] for k in item], pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                        names=[id_col, "item_id", "score", "first_word", "n_words"],
                    )

        part = texts.mapInArrow(words.thrifty(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, min_item_words: int = MIN_ITEM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in whose text no item is found (see `leaks`); repeated rows each stay or go alike."""
    bounded(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    out = docs
    for rows in _blocks(_source(benchmark, item_id, item_text), block_bytes):
        items = prepare(rows, texts, min_score, min_item_words)
        if items is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found(sent.value, batch.column(text_col))
                yield batch.filter(pa.array([not m for m in found], pa.bool_()))

        out = out.mapInArrow(words.thrifty(run), docs.schema)
    return out
