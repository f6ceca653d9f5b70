import math

import numpy as np
import pytest

from textward.llm import embeddings, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, component long, weight int"


def vectors(n, seed, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for k in range(0, n // 3):  # near copies, some in a large group
        x[r.integers(n)] = x[k % 7 if k % 2 else k] + r.normal(size=dim) * 0.12
    return x.astype(np.float32)


def brute(rows):
    unit = {}
    for k, (i, v) in enumerate(rows):
        ok = i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        if ok:
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    up = {k: k for k in unit}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    keys = list(unit)
    for p, a in enumerate(keys):
        for b in keys[p + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return [(i, links[k], least[root(k)] if k in unit else i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("shards", [1, 5])
def test_links_and_groups_equal_brute_force(spark, shards):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(900, 3))]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]  # equal vectors
    rows += [(3000 + i, [c * 3 for c in rows[i][1]]) for i in range(20)]  # equal directions
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = embeddings.near_duplicates(df, shards=shards).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 0.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0])]
    rows += [(10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e-30, 0.0]), (13, [1e30, 0.0]), (None, [1.0, 0.0]), (None, None), (14, [5.0])]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], SCHEMA)
    got = embeddings.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(brute(rows), key=str)
    assert all(r.kept for r in got if r.vec_id is None)
    twice = spark.createDataFrame([(1, [1.0, 0.0])] * 3, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embeddings.near_duplicates(twice).collect()] == [(1, 2, 1, True)] * 3
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_the_graph():
    x = vectors(3000, 9, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    layers = hnsw.build(x)
    assert [len(l) for l in layers] == hnsw.levels(3000).tolist() and len(layers) > 2
    ids, _ = hnsw.beam(x, layers[0], x[:300], hnsw.enter(x, layers[1:], x[:300]), 64)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) >= 0.9


def test_the_beam_widens_until_the_audit_passes(monkeypatch):
    x = vectors(500, 4).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    shard = embeddings.Shard.build(np.arange(500), np.ones(500, int), unit)
    seen = []

    def poor(self, q, cosine, width):
        seen.append(width)
        row, node = self.exact(q, cosine)
        return (row, node) if width >= 100 else (row[::2], node[::2])

    monkeypatch.setattr(embeddings.Shard, "search", poor)
    assert shard.beam(unit, 0.9) == 128 and max(seen) == 128


def skewed():
    """Far vectors, a third in a cluster of near ones, and 40 pairs at the end."""
    r = np.random.default_rng(8)
    x = r.normal(size=(1200, 32))
    x[:400] = x[0] + r.normal(size=(400, 32)) * 0.1
    x[1160:] = x[1120:1160] + r.normal(size=(40, 32)) * 0.1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit, embeddings.Shard.build(np.arange(1200), np.ones(1200, int), unit)


def test_lost_links_of_small_groups_fail_the_audit(monkeypatch):
    unit, shard = skewed()

    def poor(self, q, cosine, width):
        row, node = self.exact(q, cosine)
        ok = (node < 400) | (width >= 64) | (np.einsum("ij,ij->i", q[row], self.unit[node]) > 1 - 1e-9)
        return row[ok], node[ok]

    monkeypatch.setattr(embeddings.Shard, "search", poor)
    assert shard.beam(unit, 0.9, own=True) == 64


def test_audit_of_rare_links_looks_at_linked_vectors_of_all_blocks(monkeypatch):
    unit, shard = skewed()
    far = np.concatenate([np.arange(400, 1200)])
    shard = embeddings.Shard.build(far, np.ones(len(far), int), unit[far])
    audited = []
    exact = embeddings.Shard.exact

    def seen(self, q, cosine):
        audited.append(q)
        return exact(self, q, cosine)

    monkeypatch.setattr(embeddings.Shard, "exact", seen)
    shard.beam(shard.unit, 0.9, own=True)
    rows = {q.tobytes() for q in audited[0]}
    assert sum(v.tobytes() in rows for v in shard.unit[720:]) == 80


def test_every_row_is_compared_where_no_beam_passes(monkeypatch):
    unit, shard = skewed()
    monkeypatch.setattr(embeddings.Shard, "search", lambda self, q, cosine, width: (np.zeros(0, int), np.zeros(0, int)))
    n = sum(len(row) for row, _ in shard.links(unit, 0.9, own=True))
    assert n == int((unit @ unit.T >= 0.9).sum()) > 400 * 400 // 2


def test_large_clusters_are_united_by_arrays():
    up = np.arange(9)
    embeddings.unite(up, np.array([8, 7, 3, 2]), np.array([7, 6, 2, 1]))
    assert up.tolist() == [0, 1, 1, 1, 4, 5, 6, 6, 6]
    embeddings.unite(up, np.array([8]), np.array([3]))
    embeddings.unite(up, np.zeros(0, int), np.zeros(0, int))
    assert up.tolist() == [0, 1, 1, 1, 4, 5, 1, 1, 1]


def test_hot_classes_and_null_vectors(spark, monkeypatch):
    from textward.llm import skew

    monkeypatch.setattr(skew, "LEAST", 20)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(200, 3))] + [(1000 + i, [1.0] * 16) for i in range(100)] + [(2000 + i, None) for i in range(50)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), shard_rows=70).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
