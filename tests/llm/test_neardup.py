import random

import numpy as np
import pytest

from textward.llm import hyperminhash, neardup
from textward.llm.components import connected
from textward.llm.scratch import Scratch

from .cases import SCHEMA, documents, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """component by id, for rows (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            common = len(sets[x] & sets[y])
            if 100 * common >= 85 * (len(sets[x]) + len(sets[y]) - common):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def near_copies():
    rows = [(i, prose(100 + i, 30 + 7 * i)) for i in range(30)]
    for k in range(90):
        rows.append((1000 + k, edited(rows[k % 30][1], k, k // 12)))
    # a large group in which few pairs are linked
    base = prose(7, 300)
    rows += [(2000 + k, edited(base, k, 1 + k % 9)) for k in range(80)]
    # short texts, where most registers are empty
    rows += [(3000 + k, prose(500 + k // 2, 5 + k // 4) + (" tail" if k % 2 else "")) for k in range(60)]
    return rows


@pytest.mark.parametrize("block", [4096, 20])
def test_groups_equal_those_of_all_pairs(spark, block):
    rows = near_copies()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(rows) - 60  # the fixture does hold groups


def test_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(documents())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].component_id for i in range(4)] == [0, 0, 0, 0]
    assert by[7][0].component_id == 6 and by[8][0].component_id == 8
    for i in (9, 10, 11):  # no words
        assert (by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True)
    assert [r.component_id for r in by[4]] == [4, 4]  # the repeated row
    assert [(r.component_id, r.kept) for r in by[None]] == [(None, True)] * 2


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimate_is_near_the_jaccard_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.85, 0.95):
        error = []
        for _ in range(30):
            u = r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
            n = int(1000 * (1 + share) / 2)
            a, b = u[:n], u[1000 - n :]
            regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            error.append(hyperminhash.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0] - (2 * n - 1000) / 1000)
        assert abs(np.mean(error)) < 0.04


def test_registers_keep_leading_zeros_and_mantissa():
    low = np.array([1, 3 << 40, (1 << 53) - 1, 1 << 52], np.uint64)
    regs = hyperminhash.compress(low)
    assert (regs >> hyperminhash.MANTISSA).tolist() == [53, 12, 1, 1]
    assert (regs & 1023).tolist() == [0, 512, 1023, 0]
    assert hyperminhash.compress(np.array([2**64 - 1], np.uint64))[0] == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(200, 200), (301, 300), (300, 301)]
    got = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}
    assert {r.node: r.component for r in got.collect()} == want
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
