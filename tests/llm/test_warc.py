import base64
import gzip
import hashlib
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textward.llm import warc
from textward.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, payload string, digest string, size int"


def pages():
    r = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example/ö p?{i}", f"<html>{i} é " + "".join(r.choice("abc \n") for _ in range(r.randrange(2000))), "x", "y", 1) for i in range(60)]
    rows += [(100 + i, None if i % 2 else "u", "<p>same</p>", None, None, None) for i in range(40)]
    rows += [(200, "u", None, None, None, None), (201, "u", "", None, None, None), (5, "v", "<p>same</p>", None, None, None)]
    rows += [rows[3], rows[99], (None, "w", "<p>same</p>", None, None, None), (None, "w", "alone", None, None, None), (300, "big", "z" * 3_000_000, None, None, None)]
    rows += [(301, "random", "".join(chr(r.randrange(32, 0x2000)) for _ in range(20000)), None, None, None)]
    return rows


def contract(rows, least=0):
    text = lambda r: (r[2] or "").encode()
    holder = {}
    for r in rows:
        if r[0] is not None and len(text(r)) >= least:
            holder[text(r)] = max(holder.get(text(r), r[0]), r[0])
    out = []
    for r in rows:
        h = holder.get(text(r), r[0])
        out.append((r[0], len(text(r)), base64.b32encode(hashlib.sha1(text(r)).digest()).decode(), "response" if h == r[0] else "revisit", None if h == r[0] else h))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, least):
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), min_payload=least).collect()
    assert sorted(map(tuple, got), key=str) == contract(rows, least)


def test_small_splits_and_archives_lose_and_repeat_nothing(spark):
    rows = pages()
    root = Scratch(spark, "test").path("archives")
    written = warc.write(spark.createDataFrame(rows, SCHEMA), root, archive_bytes=20_000).collect()
    assert sum(r.records for r in written) == len(rows)
    archives = warc.archives_in(spark, root)
    assert sorted(r.bytes for r in archives.collect()) == sorted(r.bytes for r in written)
    got = warc.read(archives, split_bytes=777).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == contract(rows)
    html = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(html[r[0]] == (r[2] or "").encode() for r in rows if r[0] in html and r[0] not in (5, None))
    urls = {r.page_id: r.url for r in got}
    assert urls[7] == "http://h1.example/ö%20p?7" and urls[101] is None


def test_archives_are_gzip_members_of_warc_records(tmp_path):
    data = warc.member(1, "u", b"hello", "D" * 32, 5, None) + warc.member(2, "u", None, "D" * 32, 5, 1)
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:textward:page:1>" in text


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8), st.integers(1, 400), st.integers(0, 1), st.integers(1, 9))
def test_every_record_has_one_owner(tmp_path, payloads, split, level, read):
    """Payloads that hold magic bytes, stored (level 0) or deflated, cut anywhere."""
    payloads = [warc.MAGIC + p for p in payloads]
    data = b"".join(warc.member(i, None, p, "", len(p), None, level) for i, p in enumerate(payloads))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    old, warc._READ = warc._READ, 16 * read
    try:
        found = [warc._number(h["warc-record-id"]) for at in range(0, len(data), split) for h, _ in warc.records(str(path), at, at + split)]
    finally:
        warc._READ = old
    assert found == list(range(len(payloads)))


def test_damaged_bytes_between_members_are_passed_over(tmp_path):
    a, b = (warc.member(i, None, b"x" * 50, "", 50, None) for i in range(2))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk\x1f\x8b\x08junk" + a + b"\x1f\x8b\x08" + b + a[:30])
    assert [warc._number(h["warc-record-id"]) for h, _ in warc.records(str(path), 0, 1 << 20)] == [0, 1]


def test_a_changed_payload_fails(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(1, None, b"abc", "A" * 32, 3, None))
    frame = spark.createDataFrame([(str(path), os.path.getsize(path))], "path string, bytes long")
    with pytest.raises(Exception, match="digest"):
        warc.read(frame).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_records_without_their_headers_are_passed_over(tmp_path):
    good = [warc.member(i, None, b"x" * 50, "", 50, None) for i in range(2)]
    bad = [gzip.compress(h + b"\r\n\r\nbody\r\n\r\n") for h in (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a:7>", b"WARC/1.1\r\nContent-Length: x\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a:8>", b"WARC/1.1\r\nContent-Length: 4")]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good[0] + b"".join(bad) + good[1])
    assert [warc._number(h["warc-record-id"]) for h, _ in warc.records(str(path), 0, 1 << 20)] == [0, 1]


def test_a_second_attempt_replaces_no_archive(spark):
    root = Scratch(spark, "test").path("archives")
    written = warc.write(spark.createDataFrame(pages(), SCHEMA), root)
    first, second = written.collect(), written.collect()
    assert not {r.path for r in first} & {r.path for r in second}
    for manifest in (first, second):
        assert warc.read(spark.createDataFrame(manifest)).count() == len(pages())
