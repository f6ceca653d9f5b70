"""Near-duplicate embeddings: small-world graphs by shard, every shard queried, links verified, groups united.

1. Vectors with equal components form a class; one representative of each goes on.
2. Representatives are dealt over shards. A task builds its shard's graph, finds the links
   inside it and their components, and writes all to the shared folder.
3. For each pair of shards a task searches one's graph for all vectors of the other; a link counts
   for both its ends. Its beam is doubled until an audit against brute force finds a mean share of RECALL of
   the links of each vector that has some, among AUDIT drawn from all and half as many that the
   first beam found links of; links to itself don't count. Where no beam of less than half
   the shard passes, every row is compared. Cosines are verified in double precision.
   A vector's links are counted, and one of them for each component of the shard is passed on,
   so large groups of near vectors yield no list of pairs.
4. Components of these links are the groups.

The number of shards is SHARDS, or more where a shard would hold over SHARD_ROWS vectors or SHARD_BYTES.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import files, hnsw, skew, words
from textward.llm.components import connected
from textward.llm.scratch import Scratch

COSINE = 0.9
SHARDS = 6
SHARD_ROWS = 1 << 16
SHARD_BYTES = 64 << 20
BEAM = 8
AUDIT = 256
RECALL = 0.999
_BLOCK = 512
#: Links of the first beam that are kept until its audit has passed.
_KEPT_LINKS = 1 << 20


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; no row is zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shard:
    """A graph over unit vectors, with what its rows stand for."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, layers: list[np.ndarray], component: np.ndarray) -> None:
        self.ids, self.weight, self.unit, self.layers, self.component = ids, weight, unit, layers, component
        self.small = unit.astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> Shard:
        return cls(ids, weight, unit, hnsw.build(unit.astype(np.float32)), np.arange(len(ids)))

    def save(self, uri: str) -> None:
        arrays = [self.ids, self.weight, self.unit, self.component, *self.layers]
        head = np.array([len(self.ids), self.unit.shape[1], len(self.layers), *(n for a in self.layers for n in a.shape)], np.int64)
        files.publish(uri, [np.array([len(head)], np.int64).tobytes(), head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])

    @classmethod
    def load(cls, uri: str) -> Shard:
        data = files.mapped(uri, np.uint8)
        at = 0

        def take(shape: tuple[int, ...], dtype) -> np.ndarray:
            nonlocal at
            size = math.prod(shape) * np.dtype(dtype).itemsize
            out = data[at : at + size].view(dtype).reshape(shape)
            at += size
            return out

        head = take((int(take((1,), np.int64)[0]),), np.int64)
        n, d, k = (int(x) for x in head[:3])
        ids, weight, unit, component = take((n,), np.int64), take((n,), np.int64), take((n, d), np.float64), take((n,), np.int64)
        return cls(ids, weight, unit, [take((int(head[3 + 2 * j]), int(head[4 + 2 * j])), np.int32) for j in range(k)], component)

    def exact(self, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """All links of queries, by comparing them with every row."""
        rows, nodes = [], []
        for a in range(0, len(self.unit), 8192):
            r, n = np.nonzero(q @ self.unit[a : a + 8192].T >= cosine)
            rows.append(r)
            nodes.append(n + a)
        return np.concatenate(rows), np.concatenate(nodes)

    def search(self, q: np.ndarray, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        row, node = hnsw.within(self.small, self.layers, q.astype(np.float32), cosine, width)
        ok = (q[row] * self.unit[node]).sum(axis=1) >= cosine
        return row[ok], node[ok]

    def beam(self, q: np.ndarray, cosine: float, own: bool = False) -> int | None:
        """A beam's width with which an audit passes, None if none does. own: the queries are the shard's rows, whose links to themselves don't count."""
        return self._audited(q, cosine, own)[0]

    def links(self, q: np.ndarray, cosine: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all links by blocks of queries; by brute force where no beam passes its audit."""
        width, parts, kept = self._audited(q, cosine, own)
        if width != BEAM:
            kept = []
        yield from kept
        for part in parts[len(kept) :]:
            yield self._of(part, q, cosine, width)

    def _audited(self, q: np.ndarray, cosine: float, own: bool) -> tuple[int | None, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """The width that passes, the blocks of queries, and the links that the first beam found of the first of them."""
        order = np.random.default_rng(len(q)).permutation(len(q))  # all blocks are drawn from
        parts = [np.sort(order[a : a + _BLOCK]) for a in range(0, len(q), _BLOCK)]
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        linked: list[int] = []
        held = 0
        while len(kept) < len(parts) and len(linked) < AUDIT // 2 and held < _KEPT_LINKS:
            row, node = self._of(parts[len(kept)], q, cosine, BEAM)
            kept.append((row, node))
            some = np.unique(row[row != node] if own else row)
            linked += np.random.default_rng(len(kept)).permutation(some).tolist()
            held += len(row)
        some = np.unique(np.concatenate([order[:AUDIT], np.array(linked[: AUDIT // 2], int)]))

        def count(width: int | None) -> np.ndarray:
            row, node = self._of(some, q, cosine, width)
            return np.bincount(row[row != node] if own else row, minlength=len(q))[some]

        true, width = count(None), BEAM
        if not true.any():
            return BEAM, parts, kept
        while 2 * width < len(self.ids):  # beyond that, comparing every row costs less
            if np.mean(count(width)[true > 0] / true[true > 0]) >= RECALL:
                return width, parts, kept
            width *= 2
        return None, parts, kept

    def _of(self, part: np.ndarray, q: np.ndarray, cosine: float, width: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the links of the queries numbered part; width None: by comparing them with every row."""
        row, node = self.exact(q[part], cosine) if width is None else self.search(q[part], cosine, width)
        return part[row], node


def unite(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of each x and y; up holds every node's parent, the least node of a tree is its root."""
    while True:
        while (up[up] != up).any():
            up[:] = up[up]
        x, y = up[x], up[y]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))


def _path(root: str, dim: int, shard: int) -> str:
    return f"{root}/index-{dim}-{shard:05d}"


_FOUND = "kind int, a long, b long"
_COUNT, _EDGE = 0, 1


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64)})


def _build(root: str, cosine: float):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        dim, number = int(key[0]), int(key[1])
        frame = frame.sort_values("id")
        shard = Shard.build(frame["id"].to_numpy(), frame["weight"].to_numpy(), _units(np.stack(frame["vector"].to_numpy()).astype(np.float64)))
        n = len(frame)
        up, counts = np.arange(n), np.zeros(n, np.int64)
        for row, node in shard.links(shard.unit, cosine, own=True):
            row, node = row[row != node], node[row != node]
            counts += np.bincount(row, shard.weight[node], n).astype(np.int64)
            unite(up, row, node)
        shard.component = up
        shard.save(_path(root, dim, number))
        some, member = np.flatnonzero(counts), np.flatnonzero(up != np.arange(n))
        return pd.concat([_found(_COUNT, shard.ids[some], counts[some]), _found(_EDGE, shard.ids[member], shard.ids[up[member]])])

    return run


def _cross(root: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, s, t in zip(*(batch.column(c).to_pylist() for c in ("dim", "s", "t")), strict=True):
                shard, other = Shard.load(_path(root, dim, s)), Shard.load(_path(root, dim, t))
                here, there = np.zeros(len(shard.ids), np.int64), np.zeros(len(other.ids), np.int64)
                for row, node in shard.links(other.unit, cosine):
                    there += np.bincount(row, shard.weight[node], len(there)).astype(np.int64)
                    here += np.bincount(node, other.weight[row], len(here)).astype(np.int64)
                    pair = np.unique(row * np.int64(len(here)) + shard.component[node])
                    if len(pair):
                        yield pa.RecordBatch.from_pandas(_found(_EDGE, other.ids[pair // len(here)], shard.ids[pair % len(here)]), preserve_index=False)
                for side, n in ((shard, here), (other, there)):
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_pandas(_found(_COUNT, side.ids[some], n[some]), preserve_index=False)

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link. Equal vectors link.  Rows with a null id link with
    nothing; they get a null component_id and kept = true.  Rows that repeat an id count as several
    vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    vector = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, vector).alias("vector"))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    some = rows.where("vector is not null")
    classes = some.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.keep(classes, "classes")
    total = classes.count()
    width = some.agg(F.max(F.size("vector")).alias("d")).first().d or 1
    n = max(1, min(shards, total // 64), math.ceil(total / max(1, min(shard_rows, SHARD_BYTES // (8 * width)))))
    heads = some.join(classes.withColumnRenamed("least", "id"), ["h1", "h2", "id"]).dropDuplicates(["h1", "h2"])
    dealt = heads.select("id", "weight", "vector", F.size("vector").alias("dim"), F.pmod("h2", F.lit(n)).cast("int").alias("shard"))
    root = scratch.path("index")
    # an index per task
    built = scratch.keep(dealt.groupBy("dim", "shard").applyInPandas(_build(root, cosine), _FOUND), "inside")
    kinds = dealt.select("dim", "shard").distinct()
    kinds = scratch.keep(kinds, "shards")
    pairs = kinds.withColumnRenamed("shard", "s").join(kinds.withColumnRenamed("shard", "t"), "dim").where("s < t")
    # each pair is a task's work
    across = scratch.keep(pairs.repartition(max(1, min(n * n // 2, 4096)), "dim", "s", "t").mapInArrow(words.thrifty(_cross(root, cosine)), _FOUND), "across")
    found = built.union(across)
    counts = found.where(F.col("kind") == _COUNT).groupBy("a").agg(F.sum("b").alias("n"))
    groups = scratch.keep(connected(found.where(F.col("kind") == _EDGE).select("a", "b"), scratch), "groups")
    by_class = classes.join(counts.withColumnRenamed("a", "least"), "least", "left").join(groups.withColumnRenamed("node", "least"), "least", "left")
    by_class = by_class.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    component = F.coalesce("component", "id")
    linked = some.select("id", "h1", "h2")
    # only rows with a usable vector look for their class
    none = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = skew.join(linked, by_class, ["h1", "h2"], hot=skew.hot(classes, "h1", "weight"), by="id").select("id", "n_links", "component")
    return found.unionByName(none).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
