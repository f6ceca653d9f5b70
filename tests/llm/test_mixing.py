import pytest

from textward.llm import mixing

from .cases import SCHEMA, documents, prose, words


def brute_targets(sizes):
    """Targets of sources (ascending by code point, null last) by resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), list(names)
    left = 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.remove(s)
    return target


def check(docs, got, tolerance):
    sizes = {}
    for d in docs:
        sizes[d[1]] = sizes.get(d[1], 0) + len(words(d[2]))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance


@pytest.mark.parametrize("block", [50, 4096])
def test_sources_come_to_their_targets(spark, block):
    docs = [(i, "hot" if i % 3 == 0 else "s%02d" % (i % 7) if i % 11 else None, prose(i, 1 + i * 37 % 160)) for i in range(400)]
    docs += [(1000, "empty", ""), (1001, "tiny", "word")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    mix = mixing.Mix(df, block_words=block)
    got = mix.taken().collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(words(t))) for i, _, t in docs)
    check(docs, got, 0.51)
    again = mixing.mixed(df.repartition(2), block_words=block).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_slots_spread_sources_evenly(spark):
    docs = [(i, "ab"[i % 2], prose(i, 100)) for i in range(200)]
    slots = mixing.Mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), block_words=100).schedule.orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)
    share = sum(r.src == 0 for r in slots) / len(slots)
    seen = 0
    for k, r in enumerate(slots, 1):
        seen += r.src == 0
        assert abs(seen - share * k) < 6  # low discrepancy: no run of one source


def test_chunked_running_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 7)
    docs = [(i, "x", prose(i, 1 + i % 9)) for i in range(100)]
    mix = mixing.Mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), block_words=10)
    ends = 0
    for r in mix.rows.orderBy("start").collect():
        assert r.start == ends
        ends += r.size
    check(docs, mix.taken().collect(), 0.51)


def test_documents_come_as_often_as_taken(spark):
    docs = [(i, "ab"[i % 2], prose(i, 40)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    out = mixing.mixed_documents(df, block_words=100)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.source] = n.get(r.source, 0) + len(words(r.text))
    want = brute_targets({"a": 2400, "b": 2400})
    assert all(abs(n[s] - want[s]) <= 40 for s in want)


def test_edge_cases(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    check([(r[0], r[3], r[1]) for r in rows], got, 0.51)
    assert mixing.mixed_documents(docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mixed(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_no_python_on_the_main_path(spark):
    plan = mixing.mixed(spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_documents_stand_in_the_order_of_the_schedule(spark):
    docs = [(i, "abc"[i % 3], prose(i, 40), -7, -8) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, _n int, row int").repartition(3)
    out = mixing.mixed_documents(df, block_words=100)
    assert out.columns == df.columns
    places = out.selectExpr("*", "spark_partition_id() as p", "monotonically_increasing_id() as m").orderBy("p", "m").collect()
    assert all((r._n, r.row) == (-7, -8) for r in places)
    mix = mixing.Mix(df, block_words=100)
    words_ = mix.words.orderBy("slot", "first").collect()
    sums, order = {}, []
    for w in words_:
        k = (w.doc_id, w["pass"])
        if k not in sums:
            order.append(k)
        sums[k] = sums.get(k, 0) + w.n
    assert [r.doc_id for r in places] == [i for i, p in order if 2 * sums[i, p] >= 40]


def test_repeated_rows_share_their_places(spark):
    docs = [(i // 3, "a", prose(i // 3, 30)) for i in range(60)] + [(100 + i, "b", prose(i, 50)) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    taken = {r.doc_id: r.t for r in mixing.mixed(df).groupBy("doc_id").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    size = {i: len(t.split()) for i, _, t in docs}
    assert all(abs(r["count"] * size[r.doc_id] - taken[r.doc_id]) <= size[r.doc_id] for r in got)
    assert sum(r["count"] for r in got if r.doc_id < 100) > 20
