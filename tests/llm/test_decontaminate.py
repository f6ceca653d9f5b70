import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textward.llm import decontaminate as dc

from .cases import SCHEMA, documents, prose


def naive(item, window):
    """Best local alignment score by the textbook recurrence."""
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a == b else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
    return max(max(r) for r in h)


WORDS = st.lists(st.integers(0, 5), max_size=15)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_alignment_equals_the_recurrence(a, b):
    assert dc.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == naive(a, b)


def items():
    return [(k, prose(900 + k, 16 + 3 * k, 2000)) for k in range(10)]


def changed(text, seed, share):
    r, w = random.Random(seed), text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = "other%d" % r.randrange(999)
    return " ".join(w)


def test_verbatim_edited_and_reformatted_copies_are_found(spark):
    bench = items()
    docs, want = [], set()
    for k, text in bench:
        docs.append((100 + k, f"{prose(k, 50)} {text} {prose(50 + k, 70)}"))
        docs.append((200 + k, f"{prose(k, 30)} {changed(text, k, 0.1)} end"))
        docs.append((300 + k, f"{prose(k, 9)}, «{text.upper().replace(' ', ', ')}»!"))
        docs.append((400 + k, prose(70 + k, 300, 2000)))  # clean, of the same words
        docs.append((500 + k, " ".join(text.split()[:4]) + " " + prose(k, 60)))  # a short common phrase
        want |= {(100 + k, k), (200 + k, k), (300 + k, k)}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = dc.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    exact = [r for r in got if 100 <= r.doc_id < 200]
    assert all((r.score, r.first_word, r.n_words) == (1.0, 50, 16 + 3 * r.item_id) for r in exact)
    # in several blocks of items
    assert {(r.doc_id, r.item_id) for r in dc.leaks(d, b, block_bytes=400).collect()} == want
    left = {r.doc_id for r in dc.decontaminate(d, b, block_bytes=400).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_scores_equal_those_of_whole_documents(spark):
    bench = items()[:4]
    docs = [(i, f"{prose(i, 40)} {changed(bench[i % 4][1], i, 0.04 * (i % 6))} {prose(9 + i, 40)}") for i in range(24)]
    got = {(r.doc_id, r.item_id): r.score for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for i, text in docs:
        for k, item in bench:
            score = naive(item.split(), text.split()) / (dc.MATCH * len(item.split()))
            assert got.get((i, k), 0.0) == (score if score >= dc.MIN_SCORE else 0.0)


def test_a_passage_in_most_documents_stays_a_seed(spark):
    k, text = items()[5]
    docs = [(i, f"{prose(i, 20)} {text}") for i in range(200)]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, text)], "item_id long, text string"))
    assert got.count() == 200


def test_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    base = documents()[0][1]
    bench = [(1, base), (1, base), (2, None), (None, base), (3, ""), (4, "one two three"), (5, prose(2, 80))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.item_id) for r in dc.leaks(docs, b).collect()), key=str)
    assert [(d, i) for _, d, i in got] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 5), (4, 5), (6, 4), (7, 4), (None, 5)]
    left = dc.decontaminate(docs, b)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - 9
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, none).collect() == [] and dc.decontaminate(docs, none).count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    assert dc.leaks(empty, b).collect() == [] and dc.decontaminate(empty, b).collect() == []


def edited(words, r, share):
    """Words with a share of edits: other words in their place, gaps, and words between them."""
    out = []
    for w in words:
        kind = r.random()
        out += [w] if kind >= share else [["x%d" % r.randrange(99)], [], [w, "y%d" % r.randrange(99)]][r.randrange(3)]
    return out


def test_no_copy_at_or_above_the_score_is_lost(spark):
    r = random.Random(5)
    bench = [(m, ["b%dw%d" % (m, r.randrange(3 * m)) for _ in range(m)]) for m in [*range(1, 31), 45, 64]]
    docs, want, missed = [], {}, 0
    for m, item in bench:
        for k in range(14):
            i = 100 * m + k
            text = prose(i, 20).split() + edited(item, r, 0.4 * k / 13) + prose(i + 1, 25).split()
            docs.append((i, " ".join(text)))
            for n, other in bench:
                score = naive(other, text) if set(other) & set(text) else 0
                if score >= dc.least_score(n, dc.MIN_SCORE) - 1e-9:
                    want[i, n] = score / (dc.MATCH * n)
            missed += m >= dc.WHOLE and (i, m) not in want
    assert missed > 20 and len(want) > 200
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(m, " ".join(w)) for m, w in bench], "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.score for x in got.collect()} == want


def test_copies_without_an_intact_triple_and_short_items(spark):
    bench = [(1, "alpha bravo charlie delta echo foxtrot golf hotel"), (2, "one two three four five six seven"), (3, "nine ten"), (4, "zulu")]
    docs = [(1, "so alpha bravo XX delta echo YY golf hotel"), (2, "One, two, three; four five six seven."), (3, "it is ten nine"), (4, "eight nine-ten eleven zulu zulu"), (5, "two three five")]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word, r.n_words) for r in got) == [(1, 1, 0.625, 1, 8), (2, 2, 1.0, 0, 7), (4, 3, 1.0, 1, 2), (4, 4, 1.0, 4, 1)]


def test_excerpts_of_long_items(spark):
    item = prose(5, 200, 5000).split()
    docs = [(1, " ".join(prose(6, 10).split() + item[90:130])), (2, " ".join(item[90:128]))]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.score, r.first_word, r.n_words) for r in got] == [(1, 0.2, 10, 40)]
