"""Counters and histograms of decisions, grouped by a fixed catalogue of labels."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Upper bounds of buckets.
RISK_BUCKETS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
# Metrics with their kind, labels and buckets.
CATALOGUE = {
    "requests_total": ("counter", ("stage", "outcome", "enforcement"), None),
    "blocks_total": ("counter", ("stage", "reason"), None),
    "would_block_total": ("counter", ("stage", "reason"), None),
    "risk_score": ("histogram", ("stage", "kind"), RISK_BUCKETS),
    "findings_total": ("counter", ("stage", "kind", "category"), None),
    "detector_score": ("histogram", ("detector", "mode"), RISK_BUCKETS),
    "detector_errors_total": ("counter", ("detector",), None),
    "degradations_total": ("counter", ("operation", "decision"), None),
    "rate_limited_total": ("counter", ("stage",), None),
    "scan_duration_seconds": ("histogram", ("stage",), LATENCY_BUCKETS),
    "stream_leaks_total": ("counter", (), None),
}
SAMPLE = "metric string, labels map<string,string>, value double"


def sample(metric: str, value: Column | float = 1.0, **labels: Column | str) -> Column:
    """A struct (metric, labels, value); labels that the catalogue doesn't declare are refused."""
    declared = CATALOGUE[metric][1]
    if set(labels) - set(declared):
        raise ValueError(f"{metric} has the labels {declared}, not {sorted(set(labels) - set(declared))}")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for k in sorted(labels) for x in (F.lit(k), lit(labels[k]).cast("string"))]
    own = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(metric).alias("metric"), own.alias("labels"), lit(value).cast("double").alias("value"))


def samples(df: DataFrame, *columns: Column) -> DataFrame:
    """The samples (structs or nulls) of each row, as rows."""
    return df.select(F.explode(F.array_compact(F.array(*columns))).alias("s")).select("s.*")


def _labels() -> Column:
    """Maps don't group; their sorted entries do."""
    return F.array_sort(F.map_entries("labels"))


def counters(rows: DataFrame) -> DataFrame:
    """(metric, labels, value): sums by label set of the catalogue's counters."""
    names = [n for n, (kind, *_) in CATALOGUE.items() if kind == "counter"]
    out = rows.where(F.col("metric").isin(names)).groupBy("metric", _labels().alias("_l")).agg(F.sum("value").alias("value"))
    return out.select("metric", F.map_from_entries("_l").alias("labels"), "value")


def histograms(rows: DataFrame) -> DataFrame:
    """(metric, labels, le, count): how many values are at most le, for each bucket and +Inf.

    Values are counted by bucket before the sums run over buckets.
    """
    kinds = {n: b for n, (kind, _, b) in CATALOGUE.items() if kind == "histogram"}
    bounds = F.lit(None).cast("array<double>")
    for name, b in kinds.items():
        bounds = F.when(F.col("metric") == name, F.array(*[F.lit(float(x)) for x in b])).otherwise(bounds)
    rows = rows.where(F.col("metric").isin(list(kinds))).withColumn("_b", bounds)
    first = F.size(F.filter("_b", lambda b: b < F.col("value")))
    counted = rows.groupBy("metric", _labels().alias("_l"), "_b", first.alias("_first")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("metric", "_l", "_first", "n", F.posexplode(F.concat("_b", F.array(F.lit(float("inf"))))).alias("_k", "le"))
    out = each.groupBy("metric", "_l", "le").agg(F.sum(F.when(F.col("_first") <= F.col("_k"), F.col("n")).otherwise(0)).alias("count"))
    return out.select("metric", F.map_from_entries("_l").alias("labels"), "le", "count")


def exposition(counted: DataFrame, namespace: str = "textward") -> DataFrame:
    """Lines of Prometheus's text format for counters, the column line."""
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))).otherwise("")
    return counted.select(F.concat(F.lit(f"{namespace}_"), "metric", labels, F.lit(" "), F.call_function("format_number", "value", F.lit("0.######"))).alias("line"))


def histogram_lines(rows: DataFrame, namespace: str = "textward") -> DataFrame:
    """Lines of Prometheus's text format for the histograms of samples: buckets, sum and count."""
    buckets = histograms(rows).select("metric", F.map_concat("labels", F.create_map(F.lit("le"), F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))).alias("labels"), F.col("count").cast("double").alias("value"), F.lit("_bucket").alias("end"))
    names = [n for n, (kind, *_) in CATALOGUE.items() if kind == "histogram"]
    sums = rows.where(F.col("metric").isin(names)).groupBy("metric", _labels().alias("_l")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    both = sums.select("metric", F.map_from_entries("_l").alias("labels"), F.explode(F.array(F.struct(F.col("s").alias("value"), F.lit("_sum").alias("end")), F.struct(F.col("n").alias("value"), F.lit("_count").alias("end")))).alias("x"))
    every = buckets.unionByName(both.select("metric", "labels", "x.value", "x.end"))
    return exposition(every.withColumn("metric", F.concat("metric", "end")), namespace)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """df as it is, and measures (aggregates) taken while an action runs over it, without another pass; a stream reports them by progress."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in measures.items()]), watch


@contextmanager
def span(spark: SparkSession, name: str, sink: Callable[[dict], object], **attributes: object) -> Iterator[dict]:
    """Jobs inside carry the name; sink gets {name, seconds, error, **attributes} at the end. A sink that fails takes nothing down with it."""
    context, out = spark.sparkContext, {"name": name, "error": None} | attributes
    before, start = context.getLocalProperty("spark.job.description"), time.monotonic()
    context.setJobDescription(name)
    try:
        yield out
    except BaseException as e:
        out["error"] = type(e).__name__
        raise
    finally:
        context.setLocalProperty("spark.job.description", before)
        out["seconds"] = time.monotonic() - start
        try:
            sink(out)
        except Exception as e:  # noqa: BLE001 - a check doesn't fail for its trace
            log.warning("the trace of %s was lost: %s", name, e)


def of_inputs(checked: DataFrame) -> DataFrame:
    """Samples of turns as `plans.turns.inputs` returns them."""
    outcome = F.when(F.col("blocked"), "blocked").otherwise("allowed")
    mode = F.when(F.col("would_block") & ~F.col("blocked"), "shadow").otherwise("enforce")
    held = F.col("would_block")
    return samples(
        checked, sample("requests_total", stage="input", outcome=outcome, enforcement=mode), sample("risk_score", F.col("combined_risk"), stage="input", kind="combined"),
        F.when(F.col("blocked"), sample("blocks_total", stage="input", reason=F.col("reason"))), F.when(held & ~F.col("blocked"), sample("would_block_total", stage="input", reason=F.col("reason"))),
        F.when(F.col("limited"), sample("rate_limited_total", stage="input")),
    )


def of_outputs(checked: DataFrame) -> DataFrame:
    """Samples of answers as `operators.output.answer` returns them; findings count by category."""
    outcome = F.when(F.col("blocked"), "blocked").otherwise("allowed")
    mode = F.when(F.col("would_block") & ~F.col("blocked"), "shadow").otherwise("enforce")
    found = [samples(checked.select(F.explode(F.map_keys(kind)).alias("c")), sample("findings_total", stage="output", kind=kind, category=F.col("c"))) for kind in ("secrets", "pii")]
    own = samples(
        checked, sample("requests_total", stage="output", outcome=outcome, enforcement=mode),
        F.when(F.col("blocked"), sample("blocks_total", stage="output", reason=F.col("reason"))), F.when(F.col("would_block") & ~F.col("blocked"), sample("would_block_total", stage="output", reason=F.col("reason"))),
    )
    return own.unionByName(found[0]).unionByName(found[1])
