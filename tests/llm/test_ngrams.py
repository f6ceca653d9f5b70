import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from textward.llm import ngrams

from .cases import SCHEMA, documents, prose, words


def brute(train, texts, order=2):
    """The model's log10 probability by dictionaries, and the base score."""
    uni = Counter()
    grams = {k: Counter() for k in range(1, order + 1)}
    padded = lambda t: ["<"] * (order - 1) + [*words(t), None]
    for t in train:
        w = padded(t)
        uni.update(w[order - 1 :])
        grams[order].update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    if order == 1:
        grams[1] = Counter({(w,): n for w, n in uni.items()})
    followers, total = defaultdict(Counter), Counter()
    for k in range(2, order + 1):
        for g, n in grams[k].items():
            followers[g[:-1]][min(n, 3)] += 1
            total[g[:-1]] += n
    coc = lambda counts: np.array([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
    d = {k: ngrams.discounts(coc(grams[k])) for k in grams}
    v, n_all, seen = len(uni), sum(uni.values()), sum(grams[1].values())
    gamma = sum(d[1][min(k, 3)] for k in grams[1].values()) / seen if seen else 1.0

    def p(*g):
        g = g[-order:]
        if len(g) == 1:
            k = grams[1][g]
            return max(k - d[1][min(k, 3)], 0) / max(seen, 1) + gamma / (v + 1)
        if not total[g[:-1]]:
            return p(*g[1:])
        n = grams[len(g)][g]
        return (max(n - d[len(g)][min(n, 3)], 0) + sum(d[len(g)][k] * m for k, m in followers[g[:-1]].items()) * p(*g[1:])) / total[g[:-1]]

    out = []
    for t in texts:
        w = padded(t)
        own = w[order - 1 :]
        out.append((len(own), sum(uni[x] > 0 for x in own), n_all, sum(math.log10((uni[x] + 0.5) / (n_all + 0.5 * (v + 1))) for x in own), sum(math.log10(p(*w[i - order + 1 : i + 1])) for i in range(order - 1, len(w)))))
    return out, p, uni


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("merge", [ngrams.MERGE_TOKENS, 200])
def test_scores_equal_brute_force(spark, monkeypatch, merge, order):
    train = [prose(i, 5 + i % 60, 150) for i in range(120)] + ["again and again"] * 300 + [r[1] for r in documents()[:9]]
    texts = [prose(1000 + i, 1 + i % 40, 170) for i in range(60)] + [r[1] for r in documents()] + ["again and again"]
    df = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    if merge < ngrams.MERGE_TOKENS:
        run = ngrams._map

        def small(bits, order):
            inner = run(bits, order)

            def go(batches):
                from textward.llm import ngrams as n

                n.MERGE_TOKENS = merge
                yield from inner(batches)
                n.MERGE_TOKENS = 1 << 22

            return go

        monkeypatch.setattr(ngrams, "_map", small)
    model = ngrams.train(df, order=order)
    got = ngrams.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    want, p, uni = brute(train, texts, order)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    # the model is a distribution: over all known words and the unknown share
    for a in (["<"] * 3, ["w", "again"], ["again", "and"], ["never-seen"]):
        assert sum(p(*a, b) for b in uni) + p(*a, "unseen word") == pytest.approx(1.0)


def test_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    got = ngrams.scored(docs, ngrams.train(docs)).collect()
    assert len(got) == len(documents()) and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (9, 10, 11)] == [1, 1, 1]
    untrained = ngrams.scored(docs, ngrams.train(empty)).collect()
    assert all((r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0) for r in untrained)
    assert ngrams.scored(empty, ngrams.train(docs)).collect() == []


def test_held_out_text_is_likelier_than_under_the_base(spark):
    train = spark.createDataFrame([(i, prose(i, 200, 100)) for i in range(50)], "doc_id long, text string")
    test = spark.createDataFrame([(i, prose(i // 2, 200, 100)) for i in range(0, 20)], "doc_id long, text string")
    assert all(r.score > r.base_score for r in ngrams.scored(test, ngrams.train(train)).collect())
