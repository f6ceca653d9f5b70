"""The pipeline's stages over a small corpus with known faults, and its whole result."""

import itertools
from collections import Counter

import pytest

import corpus_pipeline
from textward.llm import queries

from .cases import documents, prose, words


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    bench = [(k, prose(900 + k, 30, 2000)) for k in range(5)]
    docs, labels = [], []
    for i in range(200):
        text = prose(i, 60 + i % 50, 1000).capitalize() + "."
        if i % 5 == 1:
            text = text.upper().replace(" ", "!! ")
        elif i % 10 == 2:
            text = docs[i - 2][1] + " tail"
        elif i % 20 == 3:
            text += " " + bench[i % 5][1]
        docs.append((i, text, "en", "s%d" % (i % 3), len(text)))
        if i % 2 or i % 5 == 1:
            labels.append((i, int(i % 5 != 1), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_each_stage_decides_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-2]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.collect()})
    assert ids[0] - ids[1] == {i for i in range(200) if i % 5 == 1}
    assert ids[1] - ids[2] == {i for i in range(200) if i % 10 == 2}
    assert ids[2] - ids[3] == {i for i in range(200) if i % 20 == 3}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids[3]


def test_whole_run(spark, sf_dir, tmp_path):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    want, start = [], 0
    rows = docs.select("*", "_metadata.file_name", "_metadata.row_index").collect()
    for r in sorted(rows, key=lambda r: (r.file_name, r.row_index)):
        n = len(whole.encode(r.text, add_special_tokens=False).ids) + 1
        want.append((r.doc_id, start, n))
        start += n
    assert [r[:3] for r in got] == want
    # sources alternate as in the schedule
    sources = [r.source for r in sorted(rows, key=lambda r: (r.file_name, r.row_index))]
    assert want != sorted(want) and max(len(list(g)) for _, g in itertools.groupby(sources)) < len(sources) // 2


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row int, place int, slot int, key int, n int, k int, _score double, _n int, part int"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, stage, tmp_path):
    tail = (0.5, 1, 2, 3, 4, 5, 6, 7, 8.0, 9, 10)
    rows = [(*r[:5], *tail) for r in documents()]
    spark.createDataFrame(rows, CLASH).repartition(3).write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    if stage is corpus_pipeline.encode_tokens:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert [r.n_tokens for r in got if r.doc_id in (9, 10, 11)] == [1, 1, 1]
    else:
        assert out.columns == docs.columns and all(tuple(r)[5:] == tail for r in got)
        assert {str(tuple(r)) for r in got} <= {str(r) for r in rows}
    none = stage(spark, docs.limit(0), sf_dir)
    assert none.collect() == []


def test_what_stages_do_with_nulls_and_repeats(spark, sf_dir):
    rows = [(*r[:5], r[6]) for r in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    counted = lambda f: Counter((r.doc_id, r.text) for r in f(spark, docs, sf_dir).collect())
    every = Counter((r[0], r[1]) for r in rows)
    near = counted(corpus_pipeline.drop_near_copies)
    assert near == Counter({k: 1 for k in every if k[0] not in (1, 2, 3, 7)} | {(None, None): 1, (None, rows[4][1]): 1})
    assert counted(corpus_pipeline.drop_test_items) == every  # no item in them
    mixed = counted(corpus_pipeline.mix_sources)
    assert set(mixed) <= {k for k in every if words(k[1])} and all(n <= 2 * every[k] for k, n in mixed.items())


def test_copies_of_80_to_85_per_cent_are_dropped(spark, sf_dir):
    rows, dropped, between = [], set(), 0
    for k in range(40):
        text = [f"t{k}x{i}" for i in range(100 + k)]
        rows.append((2 * k, " ".join(text)))
        n = len(text) - 4
        edits = [10, 60] if k % 2 else [10, 50, 90]  # each new word changes five shingles
        for at in edits:
            text[at] = f"edit{k}"
        rows.append((2 * k + 1, " ".join(text)))
        share = (n - 5 * len(edits)) / (n + 5 * len(edits))
        between += 0.8 <= share < 0.85
        if share >= 0.8:
            dropped.add(2 * k + 1)
    assert between >= 10 and len(dropped) < 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert got == {i for i, _ in rows} - dropped


def test_repeated_ids_are_decided_by_row(spark, sf_dir):
    base, other, third = prose(1, 80, 3000), prose(2, 80, 3000), prose(3, 80, 3000)
    rows = [(3, base, "a"), (7, base + " tail", "a"), (7, other, "a"), (8, third, "b"), (8, third, "a"), (8, third, "a"), (9, other + " tail", "a"), (5, None, "a"), (5, None, "a"), (None, base, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()]
    want = [(3, base, "a"), (7, other, "a"), (8, third, "a"), (5, None, "a"), (5, None, "a"), (None, base, "a")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
