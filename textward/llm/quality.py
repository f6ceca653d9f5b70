"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in features of its whole text. Preference pairs (a document
labelled 1 is preferred to one labelled 0) fit the weights by logistic loss on the feature
difference, P(a beats b) = sigmoid(w . (f_a - f_b)). The accept threshold is a quantile of
the strengths of the labelled sample, the one that separates its labels best; a score is the
probability scale shifted so that ACCEPT falls on that quantile.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import words
from textward.llm.scratch import bounded

#: At most about this many labelled rows are fitted (drawn by a hash of the id).
FIT_ROWS = 16384
#: Opponents that each labelled row of the more frequent label meets.
OPPONENTS = 4
ACCEPT = 0.7
_LINES = np.ones(256, dtype=bool)
_LINES[[10, 13]] = False
N_FEATURES = 129 + 9


def _distinct_share(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and share of the most frequent value, in each row."""
    n = len(rows) - 1
    share, top = np.ones(n), np.zeros(n)
    for i in range(n):
        part = values[rows[i] : rows[i + 1]]
        if len(part):
            part = np.sort(part)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            share[i] = len(cuts) / len(part)
            top[i] = np.diff(np.append(cuts, len(part))).max() / len(part)
    return share, top


def features(column: pa.Array) -> np.ndarray:
    """float32[n, N_FEATURES]: byte shares, word and line statistics of each text."""
    raw, offs = words.utf8(column)
    n = len(offs) - 1
    length = np.diff(offs)
    some = np.maximum(length, 1)
    counts = np.zeros((n, 129))
    for i in range(n):
        c = np.bincount(raw[offs[i] : offs[i + 1]], minlength=256)
        counts[i, :128] = c[:128]
        counts[i, 128] = c[128:].sum()
    share = counts / some[:, None]
    hashes, rows, starts, ends = words.word_hashes(raw, offs, spans=True)
    n_words = np.diff(rows)
    total = np.concatenate(([0], np.cumsum(ends - starts)))
    in_words = total[rows[1:]] - total[rows[:-1]]
    long_words = np.concatenate(([0], np.cumsum((ends - starts) > 16)))
    distinct, top = _distinct_share(hashes, rows)
    line_start, line_end = words.bounds(raw, offs, _LINES)
    line_rows = np.searchsorted(line_start, offs, "left")
    line_hash = np.array([zlib.crc32(raw[a:b]) for a, b in zip(line_start, line_end, strict=True)], dtype=np.int64)
    lines, _ = _distinct_share(line_hash, line_rows)
    words_some = np.maximum(n_words, 1)
    extra = np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(np.diff(line_rows)),
            in_words / words_some,
            (long_words[rows[1:]] - long_words[rows[:-1]]) / words_some,
            distinct,
            top,
            lines,
            share[:, 65:91].sum(axis=1),
            n_words == 0,
        ]
    )
    return np.concatenate([np.sqrt(share), extra], axis=1).astype(np.float32)


@dataclass
class Ranker:
    """Fitted strengths: (features - mean) / scale . weights, accepted from `threshold` on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _pairs(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of the more frequent label against OPPONENTS rows of the other, in turn."""
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    i = np.repeat(many, OPPONENTS)
    j = few[(np.arange(len(i)) * 7919 + np.repeat(np.arange(len(many)), OPPONENTS)) % len(few)]
    return (i, j) if many is good else (j, i)


def fit(x: np.ndarray, label: np.ndarray, *, ridge: float = 1e-3, steps: int = 40) -> Ranker:
    """Newton's method on the mean logistic loss of the pairs plus ridge * |w|^2 / 2.

    With labels of one kind there is nothing to compare: every text scores ACCEPT or above
    if they are 1 or none is given, and below it if they are 0.
    """
    x = x.astype(np.float64)
    if not len(x) or label.min() == label.max():
        d = x.shape[1]
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if not len(x) or label.min() else 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    a, b = _pairs(np.flatnonzero(label == 1), np.flatnonzero(label == 0))
    diff = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # probability of an upset
        grad = ridge * w - diff.T @ p / len(diff)
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    order = np.sort(strength)
    grid = np.unique(np.quantile(order, np.linspace(0.002, 0.998, 499)))
    right = [((strength >= t) == (label == 1)).mean() for t in grid]
    best = np.flatnonzero(np.array(right) == max(right))
    return Ranker(mean, scale, w, float(grid[best].mean()))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in words.slices(batch.column("text")):
            x = features(batch.column("text").slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Ranker:
    """Fit on labelled rows of docs: all of them, or about fit_rows drawn by a hash of the id.

    Null ids and labels other than 0 and 1 are left out; an id with several labels counts as 0
    if one of them is 0.  The sample's features (0.6 KB a row) come to the driver.
    """
    bounded(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n))
    rows = texts.join(F.broadcast(known), "id").select("label", "text").mapInArrow(words.thrifty(_feature_rows), "label int, x binary").collect()
    if not rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    pairs = sorted((bytes(r.x), r.label) for r in rows)  # the fit doesn't depend on the order of tasks
    return fit(np.frombuffer(b"".join(x for x, _ in pairs), np.float32).reshape(-1, N_FEATURES), np.array([y for _, y in pairs]))


def scored(docs: DataFrame, ranker: Ranker, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from the whole text (null: as empty); an own column of that name is replaced."""
    bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            out = [sent.value.score(features(text.slice(a, b - a))) for a, b in words.slices(text)]
            keep = [c for c in batch.schema.names if c != score_col]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*keep, score_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != score_col]
    return docs.mapInArrow(words.thrifty(run), ", ".join([*fields, f"`{score_col}` double"]))
