"""Every registered query of the core runs over the smallest tables, and equals its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

from textward.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, int) and abs(v) < 1 << 52 or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows
    if name in catalog.SQL:
        cur = db.execute(catalog.SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
        assert rows == want


def test_queries_hold_signals(spark):
    """The planted inputs reach each decision: agreement isn't vacuous."""
    decisions = {r.decision for r in catalog.ingest_by_source(spark, SF).collect()}
    assert decisions == {"accept", "quarantine", "reject"}
    assert {r.reason for r in catalog.tampered(spark, SF).collect()} == {"verified", "no_provenance_record", "content_hash_mismatch", "ingested_as_quarantine", "ingested_as_reject"}
    answers = catalog.output.answer(catalog.documents(spark, SF)).select("reason").distinct().collect()
    assert {r.reason for r in answers} >= {"none", "secret"}
    assert {r.severity for r in catalog.exfil_pages(spark, SF).collect()} >= {"block", "neutralize", "notice"}


def test_every_answer_is_streamed_and_compared(spark, monkeypatch):
    rows = [(1, 1, "first answer"), (1, 3, "a later one " * 9), (2, 1, "fine"), (2, 3, "a wrong one " * 9), (2, 5, "fine"), (3, 1, "wrong"), (3, 1, "also"), (3, 1, "also"), (4, 1, ""), (4, 3, None), (None, 1, "no id")]
    said = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    expected = {str(i) if i else None: True for i, _, _ in rows}
    assert {r.stream_id: r.same for r in catalog.streams_alike(said).collect()} == expected
    batch = catalog.streamed.batch
    monkeypatch.setattr(catalog.streamed, "batch", lambda chunks, guard: batch(chunks, guard).withColumn("text", catalog.F.expr("replace(text, 'wrong', 'other')")))
    got = catalog.streams_alike(said).collect()
    assert len(got) == 5 and {r.stream_id: r.same for r in got} == expected | {"2": False, "3": False}
