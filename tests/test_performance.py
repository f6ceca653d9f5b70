"""Scanners take time in proportion to the text, and at least 20,000 characters a second. Not a benchmark."""

import json
import time

import pytest
from pyspark.sql import functions as F

from textward.functions.patterns import PatternError, load_file
from textward.operators import exfil, output, scan
from textward.streaming import output as streamed

SMALL, LARGE, ROWS = 8_000, 64_000, 24
PROSE = "The quarterly report is on [the site](https://ok.example/r.html), and costs fell by 12 per cent. "


def text(n):
    return (PROSE * (n // len(PROSE) + 1))[:n]


def best(run):
    took = []
    for _ in range(3):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def scans(spark, n):
    df = spark.createDataFrame([(i, text(n)) for i in range(ROWS)], "id int, text string").repartition(4).cache()
    df.count()
    noop = lambda out: out.write.format("noop").mode("overwrite").save()
    return {"scan": lambda: noop(scan.scan(df)), "answer": lambda: noop(output.answer(df))}


@pytest.mark.parametrize("name", ["scan", "answer"])
def test_scans_are_linear(spark, name):
    small, large = (best(scans(spark, n)[name]) for n in (SMALL, LARGE))
    assert large <= 24 * small and ROWS * LARGE / large > 20_000


def test_streams_are_linear():
    def run(n):
        t = text(n)
        return lambda: streamed.run(streamed.Guard(), [*(t[i : i + 64] for i in range(0, n, 64)), None])

    small, large = best(run(SMALL)), best(run(LARGE))
    assert large <= 24 * small and LARGE / large > 20_000


def test_many_urls_are_linear():
    link = "![a](http://e.example/a.png) <img src='http://e.example/b.png'> http://e.example/c "
    small, large = (best(lambda n=n: exfil.constructs(link * n)) for n in (500, 4000))
    assert large <= 24 * small
    assert len(exfil.constructs(link * 50)) == 150


def test_a_flood_of_encoded_tokens(spark):
    flood = " ".join(["QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNk"[:36]] * 20_000)
    df = spark.createDataFrame([(flood,)], "text string")
    assert scan.scan(df, max_chars=None).select(F.size("decoded").alias("n")).first().n == 256


def test_patterns_that_java_cannot_read_fail_at_load(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"secret_patterns": [{"name": "p", "pattern": "(a)(?(1)b|c)"}]}))
    with pytest.raises(PatternError, match="p"):
        load_file(str(path))
