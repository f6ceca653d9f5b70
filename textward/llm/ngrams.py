"""An interpolated modified Kneser-Ney n-gram model, counted in Spark over all training texts.

Tokens are words (runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased) and one end a
text; order - 1 begin marks stand before a text.

Counting: a task merges the n-grams of some millions of tokens before it passes them on, as arrays
for each shard (the top bits of the n-gram's hash): the words that occur and, of each n-gram, the
numbers of its words among them and its count. A shard's task merges its arrays and writes sorted hash arrays of
n-grams and counts. It passes on what it adds to contexts (total, and how many followers are seen once, twice
and more often) to the shards of the contexts, and to n-grams shorter by their first word a continuation count
of 1 each to theirs, down to single words. So neither a frequent n-gram nor a frequent context stands
in one task: whatever comes to a shard has been merged before.

    p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) p(w | h without its first word)
    p(w) = max(k(w) - E(k(w)), 0) / K + gamma / (V + 1)

with c the counts, below the highest order the continuation counts (distinct words before), k(w) the words before
w, K their sum, V the distinct tokens, and D and E the discounts of modified Kneser-Ney for counts
of 1, 2 and more, from counts of counts of each order. Unseen contexts back off, unseen words
to the uniform share. Workers map the files and search them for the distinct n-grams of a batch in order of hash.

ORDER is two: seven in ten of the check corpus's trigrams are distinct, and counting them takes
more than four times the input on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import files, words
from textward.llm.scratch import Scratch

BEGIN = np.uint64(0x1F83D9ABFB41BD6B)
END = np.uint64(0x5BE0CD19137E2179)
#: Tokens that a task merges at once.
MERGE_TOKENS = 1 << 22
SHARD_BYTES = 8 << 20
ORDER = 2
_BIG = 255


def tokens(column: pa.Array, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """Token hashes of all texts (words, then END), with those 1 .. order - 1 places before, the farthest first; each text's offset."""
    raw, offs = words.utf8(column)
    h, rows = words.word_hashes(raw, offs)
    out_rows = rows + np.arange(len(rows))
    out = np.empty(int(out_rows[-1]), np.uint64)
    body = np.ones(len(out), bool)
    body[out_rows[1:] - 1] = False
    out[body] = h
    out[~body] = END
    columns = [out]
    for _ in range(order - 1):
        before = np.empty_like(out)
        before[1:] = columns[0][:-1]
        before[out_rows[:-1]] = BEGIN
        columns.insert(0, before)
    return columns, out_rows


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return words.mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams, given their first words, their second ones and so on; a word is its own."""
    return reduce(pair_key, columns)


_UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(x) for x in arrays), *(x.itemsize for x in arrays)], np.int64)
    return b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays, of unsigned numbers, that were packed."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for size, width in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        out.append(np.frombuffer(data, _UNSIGNED[width], size, at))
        at += size * width
    return out


def _small(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    top = int(n.max()) if len(n) else 0
    return n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _by_shard(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards present in sorted h, and where each begins (with the end)."""
    shard = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(h)])) if len(h) else np.zeros(1, np.int64)
    return shard[cuts[:-1]] if len(h) else np.zeros(0, np.int64), cuts


def _rows(shards, kinds, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "data"])


#: What a packed row holds: counts of words, n-grams, words' continuation counts, parts of contexts, numbers for the driver.
WORDS, GRAMS, SEEN, CONTEXT, STATS = range(5)
_SCHEMA = "shard int, kind int, level int, data binary"


def _rows(shards, kind: int, level: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, level, np.int32)), pa.array(data, pa.binary())], names=["shard", "kind", "level", "data"])


def _word_rows(keys: np.ndarray, n: np.ndarray, kind: int, bits: int) -> pa.RecordBatch:
    """Sorted words with a number each, by the words' shards."""
    shards, cuts = _by_shard(keys, bits)
    return _rows(shards, kind, 1, [pack(keys[x:y], _small(n[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])


def _gram_rows(columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """N-grams, merged, with how often each stands in columns, by their shards."""
    key, at, n = np.unique(gram_key(columns), return_index=True, return_counts=True)
    shards, cuts = _by_shard(key, bits)
    data = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own, code = np.unique(np.concatenate([c[at[x:y]] for c in columns]), return_inverse=True)
        data.append(pack(own, *[_small(c) for c in code.reshape(len(columns), -1)], _small(n[x:y])))
    return _rows(shards, GRAMS, len(columns), data)


def _merge(columns: list[list[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
    word, n = np.unique(columns[-1], return_counts=True)
    yield _word_rows(word, n, WORDS, bits)
    if len(columns) > 1:
        yield _gram_rows(columns, bits)
    else:
        yield _word_rows(word, n, SEEN, bits)


def _map(bits: int, order: int = ORDER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x, y in words.slices(batch.column("text")):
                columns, _ = tokens(batch.column("text").slice(x, y - x), order)
                held.append(columns)
                size += len(columns[0])
                if size >= MERGE_TOKENS:
                    yield from _merge(held, bits)
                    held, size = [], 0
        if size:
            yield from _merge(held, bits)

    return run


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def _counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


def _each(df: DataFrame, run, bits: int) -> DataFrame:
    """run(shard, rows) over the rows of each shard; a shard is a task of its own, so no task holds several by chance."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            yield from run(table.column("shard")[0].as_py(), table).to_batches()

    return df.repartitionById(1 << bits, F.col("shard")).mapInArrow(words.thrifty(whole), _SCHEMA)


def _grams_of_shard(root: str, bits: int, level: int):
    """Writes a shard's n-grams of so many words; passes on parts of contexts and the n-grams of one word less."""

    def run(shard: int, table: pa.Table) -> pa.Table:
        out = []
        parts, counts, found, times = [], [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            own, *code = unpack(data)
            if kind == WORDS:
                found.append(own)
                times.append(code[0])
            else:
                parts.append([own[c] for c in code[:-1]])
                counts.append(code[-1])
        if found:
            out.append(_rows([shard], WORDS, 1, [pack(*(x if k == 0 else _small(x) for k, x in enumerate(_add(found, times))))]))
        if not parts:
            return pa.Table.from_batches(out)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        k, at, inverse = np.unique(gram_key(columns), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)
        columns = [c[at] for c in columns]
        big = np.flatnonzero(n >= _BIG)
        _save(root, f"gram{level}", shard, key=k, count=np.minimum(n, _BIG).astype(np.uint8), big=big.astype(np.int64), bigs=n[big])
        context, of = np.unique(gram_key(columns[:-1]), return_inverse=True)
        parts = [np.bincount(of, n, len(context)).astype(np.int64)] + [np.bincount(of, m, len(context)).astype(np.int64) for m in (n == 1, n == 2, n >= 3)]
        shards, cuts = _by_shard(context, bits)
        out.append(_rows(shards, CONTEXT, level, [pack(context[x:y], *[_small(c[x:y]) for c in parts]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]))
        if level > 2:
            out.append(_gram_rows(columns[1:], bits))
        else:
            out.append(_word_rows(*np.unique(columns[-1], return_counts=True), SEEN, bits))
        out.append(_rows([-1], STATS, level, [np.append(_counts_of_counts(n), shard).astype(np.int64).tobytes()]))
        return pa.Table.from_batches(out)

    return run


def _words_and_contexts(root: str):
    """Writes a shard's words, and its contexts of each order."""

    def run(shard: int, table: pa.Table) -> pa.Table:
        got: dict[tuple[int, int], tuple[list, list]] = {}
        for kind, level, data in zip(*(table.column(c).to_pylist() for c in ("kind", "level", "data")), strict=True):
            k, *n = unpack(data)
            keys, counts = got.setdefault((kind, level), ([], []))
            keys.append(k)
            counts.append(n)
        out = []
        for (kind, level), (keys, counts) in got.items():
            if kind == CONTEXT:
                k, of = np.unique(np.concatenate(keys), return_inverse=True)
                sums = [_small(np.bincount(of, np.concatenate(c), len(k)).astype(np.int64)) for c in zip(*counts, strict=True)]
                _save(root, f"context{level}", shard, key=k, total=sums[0], one=sums[1], two=sums[2], more=sums[3])
                out.append(_rows([-1], CONTEXT, level, [np.array([shard], np.int64).tobytes()]))
        if (WORDS, 1) in got:
            word, n = _add(got[WORDS, 1][0], [c[0] for c in got[WORDS, 1][1]])
            seen_key, seen = _add(got[SEEN, 1][0], [c[0] for c in got[SEEN, 1][1]])  # every word has something before it
            before = np.zeros(len(word), np.int64)
            before[np.searchsorted(word, seen_key)] = seen
            _save(root, "word", shard, key=word, count=n, before=before)
            out.append(_rows([-1], WORDS, 1, [np.concatenate((_counts_of_counts(before), [len(word), n.sum(), before.sum(), shard])).astype(np.int64).tobytes()]))
        return pa.Table.from_batches(out)

    return run


def _save(root: str, what: str, shard: int, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        files.publish(f"{root}/{what}-{shard:05d}.{name}", [np.ascontiguousarray(values).tobytes()])


def discounts(coc: np.ndarray) -> np.ndarray:
    """For counts 0, 1, 2 and more, from the numbers of entries counted 1, 2, 3 and 4 times.

    Half the count stands in where an estimate is undefined or not positive: a discount of 0 would
    leave nothing for what is unseen.
    """
    t = [float(x) for x in coc]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * t[k] / t[k - 1] if t[k - 1] and y else 0.0
        out.append(d if 0 < d else k / 2)
    return np.array(out)


@dataclass
class Model:
    root: str
    bits: int
    order: int
    shards: dict[str, frozenset[int]]  # of words, and of the n-grams and contexts of each order
    gram_discount: dict[int, np.ndarray]
    word_discount: np.ndarray
    gamma: float
    seen: int  # sum of the words' continuation counts
    distinct: int  # V
    total: int  # N


class Tables:
    """A model's arrays, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}

    def array(self, what: str, shard: int, name: str, dtype=None) -> np.ndarray:
        """An array of a shard; without a dtype, of numbers in as many bytes as the file has for each key."""
        at = (what, shard, name)
        if at not in self.open:
            uri = f"{self.model.root}/{what}-{shard:05d}.{name}"
            data = files.mapped(uri, dtype or np.uint8)
            self.open[at] = data if dtype else data.view(_UNSIGNED[len(data) // len(self.array(what, shard, "key", np.uint64))])
        return self.open[at]

    def find(self, what: str, h: np.ndarray, fields: dict[str, type | None], big: bool = False) -> list[np.ndarray]:
        """The fields of sorted keys, 0 where the model has none."""
        out = [np.zeros(len(h), np.int64) for _ in fields]
        shards, cuts = _by_shard(h, self.model.bits)
        for s, x, y in zip(shards.tolist(), cuts[:-1], cuts[1:], strict=True):
            if s not in self.model.shards.get(what, ()):
                continue
            held = self.array(what, s, "key", np.uint64)
            k = np.minimum(np.searchsorted(held, h[x:y]), len(held) - 1)
            ok = held[k] == h[x:y]
            k = k[ok]
            for o, (name, dtype) in zip(out, fields.items(), strict=True):
                n = self.array(what, s, name, dtype)[k].astype(np.int64)
                large = np.flatnonzero(n == _BIG) if big else ()
                if len(large):
                    n[large] = self.array(what, s, "bigs", np.int64)[np.searchsorted(self.array(what, s, "big", np.int64), k[large])]
                o[x:y][ok] = n
        return out

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count, and Kneser-Ney probability, of each word of sorted h."""
        m = self.model
        count, before = self.find("word", h, {"count": np.int64, "before": np.int64})
        own = np.maximum(before - m.word_discount[np.minimum(before, 3)], 0) / max(m.seen, 1)
        return count, own + m.gamma / (m.distinct + 1)

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams: the share of their own counts, and the weight of backing off."""
        level = len(columns)
        discount = self.model.gram_discount[level]
        context = gram_key(columns[:-1])
        key, of = np.unique(pair_key(context, columns[-1]), return_inverse=True)
        (n,) = self.find(f"gram{level}", key, {"count": np.uint8}, big=True)
        n = n[of]
        key, of = np.unique(context, return_inverse=True)
        total, *followers = self.find(f"context{level}", key, dict.fromkeys(("total", "one", "two", "more")))
        known = np.maximum(total, 1)
        gamma = np.where(total > 0, sum(d * f for d, f in zip(discount[1:], followers, strict=True)) / known, 1.0)
        return np.where(n > 0, n - discount[np.minimum(n, 3)], 0.0) / known[of], gamma[of]

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        m = self.model
        columns, rows = tokens(column, m.order)
        n = len(rows) - 1
        word, of_word = np.unique(columns[-1], return_inverse=True)
        count, p_word = self.words(word)
        _, first, of_gram = np.unique(gram_key(columns), return_index=True, return_inverse=True)
        p = p_word[of_word[first]]
        distinct = [c[first] for c in columns]
        for level in range(2, m.order + 1):
            own, gamma = self.grams(distinct[m.order - level :])
            p = own + gamma * p
        log_p = np.log10(p)
        base = np.log10((count + 0.5) / (m.total + 0.5 * (m.distinct + 1)))
        row = np.repeat(np.arange(n), np.diff(rows))
        return {
            "n_tokens": np.diff(rows).astype(np.int64),
            "n_known": np.bincount(row, (count > 0)[of_word], n).astype(np.int64),
            "base_score": np.bincount(row, base[of_word], n),
            "score": np.bincount(row, log_p[of_gram], n),
        }


def train(docs: DataFrame, *, text_col: str = "text", order: int = ORDER) -> Model:
    """Count all texts (null: empty, one end token). Without texts every token has probability 1.

    A text that stands twice counts twice. Columns of other names are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    root = scratch.path("model")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = 64 if size >= 1 << 60 else min(max(16, size // SHARD_BYTES), 1 << 16)
    bits = int(shards - 1).bit_length()
    mapped = docs.select(F.col(text_col).alias("text")).mapInArrow(words.thrifty(_map(bits, order)), _SCHEMA)
    step, levels = mapped, []
    for level in range(order, 1, -1):
        mine = step.where(F.col("kind").isin(GRAMS, WORDS) if level == order else F.col("kind") == GRAMS)
        step = scratch.keep(_each(mine, _grams_of_shard(root, bits, level), bits), f"grams{level}")
        levels.append(step)
    parts = reduce(DataFrame.unionByName, levels or [mapped]).where(F.col("kind").isin(WORDS, SEEN, CONTEXT))
    done = scratch.keep(_each(parts, _words_and_contexts(root), bits), "words")
    told = reduce(DataFrame.unionByName, [t.where("shard < 0") for t in levels], done).collect()  # a few numbers from each shard
    for t in levels:
        scratch.drop(t)
    numbers: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in told:
        numbers.setdefault((r.kind, r.level), []).append(np.frombuffer(r.data, np.int64))
    grams = {level: numbers.get((STATS, level), []) for level in range(2, order + 1)}
    coc = {level: sum((x[:4] for x in g), np.zeros(4, np.int64)) for level, g in grams.items()}
    own = numbers.get((WORDS, 1), [])
    stats = sum((x[:7] for x in own), np.zeros(7, np.int64))
    held = {"word": own} | {f"gram{level}": g for level, g in grams.items()} | {f"context{level}": numbers.get((CONTEXT, level), []) for level in grams}
    word_discount = discounts(stats[:4])
    distinct, total, seen = (int(x) for x in stats[4:])
    # every training token has a token or the begin mark before it, so all are counted
    gamma = 1.0 if not seen else float(word_discount[1] * stats[0] + word_discount[2] * stats[1] + word_discount[3] * (distinct - stats[0] - stats[1])) / seen
    return Model(root, bits, order, {k: frozenset(int(x[-1]) for x in v) for k, v in held.items()}, {k: discounts(c) for k, c in coc.items()}, word_discount, gamma, seen, distinct, total)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    score: log10 probability of the text (perplexity is 10 ** (-score / n_tokens)); base_score: under
    the unigram model with half a count added.  Null texts are as empty ones: one end token.  Repeated rows
    are each scored; columns of other names are neither read nor returned.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(model)
        for batch in batches:
            for x, y in words.slices(batch.column("text"), 1 << 22):
                got = tables.score(batch.column("text").slice(x, y - x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(x, y - x), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(y - x, model.total)), pa.array(got["base_score"]), pa.array(got["score"])],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(words.thrifty(run), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
