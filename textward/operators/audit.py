"""Audit events: one table of what was decided, from every surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 5
# Kinds of events.
EVENTS = ("input_scan", "external_content_scan", "output_scan", "ingest", "ingest_review", "retrieval_provenance", "media_scan", "tool_call", "tool_result", "subject_revoked", "backend_degraded")


def events(df: DataFrame, event: str, ts: Column, *fields: str) -> DataFrame:
    """(ts, event, schema_version, data): data is the fields in JSON."""
    if event not in EVENTS:
        raise ValueError(f"no kind of event: {event}")
    return df.select(ts.cast("timestamp").alias("ts"), F.lit(event).alias("event"), F.lit(VERSION).alias("schema_version"), F.to_json(F.struct(*fields)).alias("data"))


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def degradations(log: DataFrame) -> DataFrame:
    """Counts of degraded backends by operation and decision."""
    data = F.from_json("data", "operation string, decision string")
    return log.where(F.col("event") == "backend_degraded").select(data.alias("d")).groupBy("d.operation", "d.decision").count()


def breaker(outcomes: DataFrame, *, key: str = "operation", ts: str = "ts", ok: str = "ok", failures: int = 5) -> DataFrame:
    """outcomes with failures_in_row and open: whether so many calls in a row had failed by then."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    run = outcomes.withColumn("_run", F.sum(F.col(ok).cast("int")).over(by))
    within = Window.partitionBy(key, "_run").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = run.withColumn("failures_in_row", F.sum((~F.col(ok)).cast("int")).over(within)).drop("_run")
    return out.withColumn("open", F.col("failures_in_row") >= failures)
