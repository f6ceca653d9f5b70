"""Quality classifier and language identification: held-out accuracy, brute force, edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textward.llm import language, quality, words

from .cases import SCHEMA, documents, prose


def labelled(n=240):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, r.randrange(20, 200)).capitalize() + "."
        if not good:
            text = [text.upper() + "!!!", text.replace(" ", "$$$ "), "\n".join([text[:40]] * 9)][i % 3]
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_of_held_out_documents(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    ranker = quality.train(d, known)
    got = {r.doc_id: r.score for r in quality.scored(d, ranker).collect()}
    right = [(got[i] >= quality.ACCEPT) == bool(q) for i, q, _ in labels if i % 3 == 0]
    assert sum(right) >= 0.95 * len(right)
    again = quality.train(d.repartition(5), known)
    assert np.array_equal(again.weights, ranker.weights)


def test_fit_lowers_the_pairwise_loss():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, quality.N_FEATURES))
    label = (x[:, 0] - 0.5 * x[:, 1] > -0.8).astype(int)
    m = quality.fit(x, label)
    z = (x - m.mean) / m.scale
    a, b = quality._pairs(np.flatnonzero(label == 1), np.flatnonzero(label == 0))
    loss = lambda w: np.log1p(np.exp(-(z[a] - z[b]) @ w)).mean() + 5e-4 * w @ w
    best = loss(m.weights)
    assert best < 0.3
    for _ in range(20):
        assert loss(m.weights + 0.01 * r.normal(size=len(m.weights))) >= best


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (9, 0, 0), (11, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (777, 1, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    for value, accepted in (([], True), ([1], True), ([0], False)):
        one = spark.createDataFrame([(4, v) for v in value], "doc_id long, quality int")
        assert all((r.score >= quality.ACCEPT) == accepted for r in quality.scored(docs, quality.train(docs, one)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.scored(empty, quality.train(empty, labels)).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] for r in documents()]
    whole = quality.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.array_equal(quality.features(pa.array([t], pa.string()))[0], whole[i])
    assert np.isfinite(whole).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=5), st.integers(1, 3), st.integers(0, 10**6))
def test_viterbi_finds_the_best_path(sizes, labels, seed):
    r = np.random.default_rng(seed)
    rows = np.concatenate(([0], np.cumsum(sizes)))
    scores = r.normal(size=(rows[-1], labels)).astype(np.float32)
    got = language.viterbi(scores, rows, 0.7)
    value = lambda s, path: s[np.arange(len(path)), path].sum() - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(rows[:-1], rows[1:]):
        s = scores[a:b].astype(float)
        best = max(value(s, list(p)) for p in itertools.product(range(labels), repeat=b - a))
        assert value(s, got[a:b].tolist()) == pytest.approx(best, abs=1e-5)


def sentence(lang, seed, n):
    r = random.Random(seed)
    parts = {"xx": ["ka", "lo", "mi", "tu", "re"], "yy": ["sch", "ung", "ei", "ver", "ich"], "ru": ["при", "вет", "мир", "да", "ло"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages_and_spans(spark):
    docs = [(i, sentence(l, i, 40), l) for i, l in enumerate(["xx", "yy", "ru"] * 40)]
    train = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.train(train.repartition(3), fit_rows=30)
    assert model.languages == ["ru", "xx", "yy"]
    test = [(1000 + i, sentence(l, 5000 + i, 25), l) for i, l in enumerate(["xx", "yy", "ru"] * 20)]
    mixed = sentence("xx", 1, 30) + " 12 " + sentence("yy", 2, 20) + " — " + sentence("ru", 3, 10)
    got = {r.doc_id: r for r in language.detect(spark.createDataFrame([*[t[:2] for t in test], (1, mixed)], "doc_id long, text string"), model).collect()}
    assert all(got[i].lang_pred == l and got[i].score == 1.0 for i, _, l in test)
    spans = [(s.lang, s.n) for s in got[1].spans]
    assert [l for l, _ in spans] == ["xx", "yy", "ru"] and sum(n for _, n in spans) == 62
    assert abs(spans[0][1] - 30) <= 2 and abs(spans[1][1] - 21) <= 2
    assert got[1].lang_pred == "xx" and got[1].score == pytest.approx(0.5, abs=0.05)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    model = language.train(docs)
    got = language.detect(docs, model).collect()
    assert len(got) == len(documents())
    by = {r.doc_id: r for r in got}
    for i in (9, 10, 11, 12):  # no letters
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert all(r.lang_pred in ("de", "en", "und") and 0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.detect(docs, nothing).collect()} == {"und"}
    assert language.detect(empty, model).collect() == []


def naive_features(text):
    """The features of a text from its bytes, one by one."""
    data = (text or "").encode()
    n = max(len(data), 1)
    share = [sum(b == k for b in data) / n for k in range(128)] + [sum(b >= 128 for b in data) / n]
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    split = lambda d, cut: [w for w in bytes(10 if b in cut else b for b in d).split(b"\n") if w]
    own, lines = split(low, [32, *range(9, 14)]), split(data, [10, 13])
    distinct = lambda xs: len(set(xs)) / len(xs) if xs else 1.0
    most = max(own.count(w) for w in set(own)) / len(own) if own else 0.0
    some = max(len(own), 1)
    extra = [np.log1p(len(own)), np.log1p(len(lines)), sum(map(len, own)) / some, sum(len(w) > 16 for w in own) / some, distinct(own), most, distinct(lines), sum(share[65:91]), not own]
    return np.array([*np.sqrt(share), *extra], np.float64)


def test_features_and_scores_equal_a_naive_version(spark):
    docs, labels = labelled(60)
    texts = [t for _, t in docs] + [r[1] for r in documents()]
    x = np.stack([naive_features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts, pa.string())), x, atol=1e-6)
    # pairs: every row of the more frequent label meets OPPONENTS of the other
    good, bad = (np.array([i for i, q, _ in labels if q == k]) for k in (1, 0))
    a, b = quality._pairs(good, bad)
    assert sorted(a) == sorted(np.repeat(good, quality.OPPONENTS)) and set(b) <= set(bad)
    m = quality.fit(x[:60].astype(np.float32), np.array([q for _, q, _ in labels]))
    # plain gradient descent on the same pairs ends where Newton's method does
    z = np.clip((x[:60] - m.mean) / m.scale, -8, 8)
    a, b = quality._pairs(np.array([i for i, q, _ in labels if q]), np.array([i for i, q, _ in labels if not q]))
    w = np.zeros(x.shape[1])
    for _ in range(20000):
        p = 1 / (1 + np.exp((z[a] - z[b]) @ w))
        w -= 0.1 * (1e-3 * w - (z[a] - z[b]).T @ p / len(a))
    assert np.allclose(w, m.weights, atol=2e-2)
    # the threshold: no quantile of the strengths separates the labels better
    strength = z @ m.weights
    right = lambda t: np.mean([(s >= t) == (q == 1) for s, (_, q, _) in zip(strength, labels)])
    assert right(m.threshold) >= max(right(t) for t in np.quantile(strength, np.linspace(0.01, 0.99, 50))) - 1e-9
    score = m.score(x.astype(np.float32))
    for s, row in zip(score, x):
        odds = sum(min(max((v - c) / k, -8), 8) * g for v, c, k, g in zip(row, m.mean, m.scale, m.weights)) - m.threshold
        assert s == pytest.approx(1 / (1 + np.exp(-odds) * 3 / 7), abs=1e-4)


def naive_counts(rows):
    """(language, bucket) and (language, script) counts of n-grams, word by word."""
    from collections import Counter

    grams, scripts = Counter(), Counter()
    for text, lang in rows:
        for w in (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))).split(b" "):
            if not w or language.script(w.decode()) < 0:
                continue
            scripts[lang, language.script(w.decode())] += 1
            padded = np.frombuffer(b" " + w + b" ", np.uint8)
            for k in language.GRAMS:
                for i in range(len(padded) - k + 1):
                    g = np.zeros(1, np.uint64)
                    for c in words.TABLES.code[padded[i : i + k]]:
                        g = g * np.uint64(0xD6E8FEB86659FD93) + c
                    grams[lang, int(words.mix(g + np.uint64(k - 1))[0] >> np.uint64(64 - language.BITS))] += 1
            whole = words.hash_spans(padded, np.array([0]), np.array([len(padded)]))[0]
            grams[lang, int(whole >> np.uint64(64 - language.BITS))] += 1
    return grams, scripts


def test_language_counts_mask_and_votes_equal_a_naive_version(spark):
    rows = [(sentence(l, i, 12) + " x1 22 —", l) for i, l in enumerate(["xx", "yy", "ru"] * 4)] + [(None, "xx"), ("", "yy"), ("...", "ru"), ("привет", "xx")]
    model = language.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3))
    grams, scripts = naive_counts(rows)
    table = np.array([[grams[l, k] for l in model.languages] for k in range(language.BUCKETS)], float)
    logp = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * language.BUCKETS)
    assert np.allclose(model.logp, logp - logp.mean(axis=1, keepdims=True), atol=1e-5)
    for s in range(len(language.SCRIPTS)):
        n = np.array([scripts[l, s] for l in model.languages])
        total = np.array([sum(v for (x, _), v in scripts.items() if x == l) for l in model.languages])
        want = n >= language.SCRIPT_SHARE * total
        assert model.meant[s].tolist() == (want if want.any() else np.ones(3, bool)).tolist()
    texts = [" ".join(sentence(l, 50 + i, 4) for l in p) + " 7 !" for i, p in enumerate(itertools.product(["xx", "yy", "ru"], repeat=2))]
    got = language.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        own = texts[r.doc_id].split()
        labels = [s.lang for s in r.spans for _ in range(s.n)]
        assert [(s.first, s.n) for s in r.spans][-1][0] + r.spans[-1].n == len(own) == len(labels)
        votes = {l: sum(x == l and language.script(w) >= 0 for x, w in zip(labels, own)) for l in model.languages}
        best = max(sorted(votes), key=lambda l: votes[l])
        assert (r.lang_pred, r.score) == (best, pytest.approx(votes[best] / sum(votes.values())))
