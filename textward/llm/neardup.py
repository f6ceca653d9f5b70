"""Near-duplicate texts by HyperMinHash banding, estimation and exact verification.

1. One pass over the texts gives each document the size and a 128-bit hash of its shingle
   set and its HyperMinHash registers. Documents with equal sets form a class, represented
   by its least id; only representatives go on, so copies cost nothing more.
2. Representatives that share a band of registers are candidates. A bucket yields a star
   (member, least member), never all its pairs; components of the stars are *neighbourhoods*
   that contain every candidate pair.
3. Members of a neighbourhood meet in blocks of at most `block` documents (a larger
   neighbourhood meets block by block, each pair of blocks in a task of its own). There,
   candidate pairs whose collision-corrected estimate comes near the threshold are verified
   on the full shingle sets, except those already connected. A task returns one edge per member.
4. Components of those edges are the groups.

A pair at the threshold of 0.85 is missed by all bands with a probability of 4e-7, and discarded by
the estimate (0.16 below the threshold, five standard deviations) with one of 3e-7. At 0.8, the
pipeline's threshold, these are 5e-5 and 3e-6 (4.5 standard deviations).
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm import hyperminhash as hmh
from textward.llm import skew, words
from textward.llm.components import connected
from textward.llm.scratch import Scratch

SHINGLE = 5
PERCENT = 85
MARGIN = 0.16
BLOCK = 4096
#: Bytes of shingle hashes that one block may hold.
BLOCK_BYTES = 64 << 20


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and each text's offset in them."""
    raw, offs = words.utf8(column)
    hashes, rows = words.word_hashes(raw, offs)
    at, out = words.windows(rows, n)
    grams = words.combine(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    sets = []
    for i in range(len(rows) - 1):
        if out[i + 1] > out[i]:
            sets.append(np.unique(grams[out[i] : out[i + 1]]))
        elif rows[i + 1] > rows[i]:
            sets.append(words.combine(hashes[rows[i] : rows[i + 1]], int(rows[i + 1] - rows[i])))
        else:
            sets.append(np.zeros(0, np.uint64))
    ends = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def _sketch(n: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in words.slices(text):
                values, ends = shingle_sets(text.slice(a, b - a), n)
                regs = hmh.registers(values, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array(np.diff(ends)),
                        pa.array(_sums(words.mix(values), ends)),
                        pa.array(_sums(words.mix(values ^ np.uint64(0x3C79AC492BA7B653)), ends)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, hmh.BUCKETS)
            keys = hmh.bands(regs).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["band", "id"])


class _Forest:
    """Union-find over 0..n-1; the least member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _candidates(regs: np.ndarray) -> Iterator[np.ndarray]:
    """Members of each bucket with at least two, ascending."""
    keys = hmh.bands(regs)
    for j in range(keys.shape[1]):
        order = np.argsort(keys[:, j], kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(keys[order, j])) + 1):
            if len(members) > 1:
                yield np.sort(members)


def forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, least member of its group) for the groups of two or more into which links join the sets.

    Linked are sets that share a band and have 100 * |intersection| >= percent * |union|; pairs
    whose estimate is MARGIN below that, or that are already connected, are not verified.
    side: if given, only pairs across sides count.
    """
    n = len(sets)
    ends = np.zeros(n + 1, np.int64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    every = np.concatenate(sets)
    distinct, code = np.unique(every, return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)
    regs = hmh.registers(every, ends)
    seen = np.zeros((n, n), dtype=bool)
    tree = _Forest(n)
    for members in _candidates(regs):
        for k in range(len(members) - 1):
            x, rest = int(members[k]), members[k + 1 :]
            rest = rest[~seen[x, rest]]
            if side is not None:
                rest = rest[side[rest] != side[x]]
            seen[x, rest] = True
            low, high = np.minimum(size[x], size[rest]), np.maximum(size[x], size[rest])
            rest = rest[100 * low >= percent * high]
            if len(rest):
                rest = rest[hmh.estimate(regs[x], regs[rest], size[x], size[rest]) >= percent / 100 - MARGIN]
            home = tree.root(x)
            rest = [y for y in rest.tolist() if tree.root(y) != home]
            if not rest:
                continue
            mark[code[ends[x] : ends[x + 1]]] = 1
            for y in rest:
                if tree.root(y) != tree.root(x):
                    common = int(mark[code[ends[y] : ends[y + 1]]].sum())
                    if 100 * common >= percent * (int(size[x]) + int(size[y]) - common):
                        tree.join(x, y)
            mark[code[ends[x] : ends[x + 1]]] = 0
    return [(x, tree.root(x)) for x in range(n) if tree.root(x) != x]


def _meet(n: int, percent: int):
    """Rows of a partition, sorted by task: the edges that each task finds."""

    def solve(ids: list[int], sides: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(ids), kind="stable")
        side = np.array(sides)[order]
        found = forest([sets[i] for i in order], percent, side if side.any() else None)
        ids = [ids[i] for i in order]
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, sides, sets = None, [], [], []
        for batch in batches:
            text = batch.column("text")
            tasks, own, side = (batch.column(c).to_pylist() for c in ("task", "id", "side"))
            for a, b in words.slices(text):
                values, ends = shingle_sets(text.slice(a, b - a), n)
                for i in range(a, b):
                    if tasks[i] != task:
                        if len(ids) > 1:
                            yield solve(ids, sides, sets)
                        task, ids, sides, sets = tasks[i], [], [], []
                    ids.append(own[i])
                    sides.append(side[i])
                    sets.append(values[ends[i - a] : ends[i - a + 1]].copy())
        if len(ids) > 1:
            yield solve(ids, sides, sets)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; a document's
    set holds its distinct shingles of `shingle` words, or its whole word sequence if that is shorter.
    Documents are linked if 100 * |intersection| >= percent * |union|.

    Null, empty and blank texts have no shingles and are linked with nothing (component_id is
    their own id).  Rows with a null id are returned with a null component_id and kept = true.
    Rows that repeat an id are each returned; different texts of one id may be linked through each other.
    Other columns are neither read nor returned, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.keep(
        source.mapInArrow(words.thrifty(_sketch(shingle)), "id long, n_shingles long, h1 long, h2 long, regs binary"), "sketch"
    )
    some = sketch.where("n_shingles > 0 and id is not null")
    classes = scratch.keep(some.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    regs = some.join(classes.select(F.col("least").alias("id"), "h1", "h2", "n_shingles"), ["id", "h1", "h2", "n_shingles"], "left_semi").select("id", "regs")
    buckets = scratch.keep(regs.mapInArrow(words.thrifty(_band_rows), "band long, id long"), "bands")
    centre = buckets.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("last > centre").select("band", "centre")
    stars = skew.spread(buckets, centre, ["band"], by="id").where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    hoods = scratch.keep(connected(stars, scratch), "hoods")
    scratch.drop(buckets)
    links = _verified(source, hoods, classes, scratch, shingle, percent, block)
    groups = connected(links, scratch)
    by_class = classes.join(groups.withColumnRenamed("node", "least"), "least", "left").select(
        "h1", "h2", "n_shingles", F.coalesce("component", "least").alias("component")
    )
    # only rows with an id and words look for their class
    known = "n_shingles > 0 and id is not null"
    rows = sketch.select("id", "n_shingles", "h1", "h2")
    found = skew.join(rows.where(known), by_class, ["h1", "h2", "n_shingles"], hot=skew.hot(classes, "h1", "n"), by="id").select("id", "n_shingles", "component")
    out = found.unionByName(rows.where(f"not ({known})").select("id", "n_shingles", F.col("id").alias("component")))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _verified(source: DataFrame, hoods: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int, percent: int, block: int) -> DataFrame:
    """Edges (member, least member of its group in a task) of the true links inside the neighbourhoods."""
    weight = classes.groupBy(F.col("least").alias("node")).agg(F.max("n_shingles").alias("w"))
    size = hoods.join(weight, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    size = size.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("w") * 8 / BLOCK_BYTES)).cast("int"))
    member = skew.spread(hoods, size, ["component"], by="node").select(F.col("node").alias("id"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    # task (i, j) with i < j sees blocks i and j, and looks at pairs across them; task (i, i) at pairs inside
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), F.when(k < F.col("own"), 1).otherwise(0).alias("side")),
    )
    tasks = member.withColumn("p", F.explode(pairs)).select("id", F.xxhash64("component", "p.i", "p.j").alias("task"), F.when(F.col("p.i") < F.col("p.j"), F.col("p.side")).otherwise(0).alias("side"))
    texts = source.where("id is not null").join(tasks, "id")
    met = texts.repartition("task").sortWithinPartitions("task", "id").mapInArrow(words.thrifty(_meet(shingle, percent)), "a long, b long")
    return scratch.keep(met, "links")
