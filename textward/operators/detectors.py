"""Detectors that score texts, and what they add up to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.operators import resilience

ENFORCING, ADVISORY = "enforcing", "advisory"
RESULT = "struct<score:double,label:string,error:string>"


@dataclass(frozen=True)
class Registration:
    name: str
    mode: str = ADVISORY
    weight: float = 1.0
    threshold: float = 0.0

    def __post_init__(self) -> None:
        if not self.name or self.mode not in (ENFORCING, ADVISORY) or not 0 <= self.weight <= 1 or not 0 <= self.threshold <= 1:
            raise ValueError(f"no valid registration: {self}")


def outcome(raw: object) -> dict:
    """A detector's answer as a result: a number in 0..1 or (number, label); anything else is an error, not a 0."""
    score, label = raw if isinstance(raw, tuple) and len(raw) == 2 else (raw, None)
    if isinstance(score, bool) or not isinstance(score, (int, float)):
        return dict(score=None, label=None, error=f"returned {type(score).__name__}, not a number")
    if not 0 <= score <= 1:
        return dict(score=None, label=None, error=f"score {score} is outside 0..1")
    return dict(score=float(score), label=label, error=None)


def detector(fn: Callable[[str], object], policy: resilience.Policy | None = None) -> Callable[[Column], Column]:
    """A function of a text as a column function; its exceptions become errors of their row.

    With a policy, a call that takes too long is an error too, and each task stops calling for a while once
    so many calls have failed.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = resilience.Guarded(fn, policy) if policy else fn

        def answer(text: str) -> dict:
            try:
                return outcome(call(text))
            except Exception as e:  # noqa: BLE001 - a detector's fault is a result
                return dict(score=None, label=None, error=f"{type(e).__name__}: {e}"[:200])

        for texts in batches:
            known: dict[str, dict] = {}
            yield pd.DataFrame([known[t] if t in known else known.setdefault(t, answer(t)) for t in texts], columns=["score", "label", "error"])

    return run


def score(docs: DataFrame, detectors: dict[str, Callable[[Column], Column]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, detector, score, label, error): equal texts are scored once."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_hash", F.sha2("_text", 256))
    texts = keyed.groupBy("_hash").agg(F.any_value("_text").alias("_text"))
    for name, run in detectors.items():
        texts = texts.withColumn(name, run(F.col("_text")))
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"`{n}`.score").alias("score"), F.col(f"`{n}`.label").alias("label"), F.col(f"`{n}`.error").alias("error")) for n in detectors])
    scored = texts.select(F.col("_hash").alias("_key"), F.explode(each).alias("r")).select("_key", "r.*")
    # texts are told apart by their hashes and don't travel with the rows
    return keyed.select(F.col("_id").alias(id_col), "_hash").join(scored, F.col("_hash").eqNullSafe(F.col("_key"))).drop("_hash", "_key")


def registered(results: DataFrame, registrations: DataFrame) -> DataFrame:
    """results with mode, weight and threshold of their detector; a result of a detector that isn't registered, or is
    registered twice, fails the query, as its verdict would be lost or count twice."""
    one = registrations.groupBy("detector").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("mode", "weight", "threshold")])
    why = F.when(F.col("_n").isNull(), F.concat(F.lit("no registration of the detector "), F.coalesce("detector", F.lit("null")))).otherwise(F.concat(F.lit("several registrations of the detector "), "detector"))
    mode = F.when(F.col("_n") == 1, F.col("mode")).otherwise(F.raise_error(why).cast("string"))
    return results.join(one, "detector", "left").withColumn("mode", mode).drop("_n")


def ensemble(results: DataFrame, registrations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, enforcing_score, advisory_score, errors, n_results) of long results and the registrations
    (detector, mode, weight, threshold) of their detectors. A score below its threshold adds 0; an error adds nothing."""
    joined = registered(results, registrations)
    adds = F.when(F.col("score") < F.col("threshold"), 0.0).otherwise(F.col("score") * F.col("weight"))
    best = lambda mode: F.coalesce(F.max(F.when((F.col("mode") == mode) & F.col("error").isNull(), adds)), F.lit(0.0))
    return joined.groupBy(id_col).agg(
        best(ENFORCING).alias("enforcing_score"), best(ADVISORY).alias("advisory_score"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("detector")))).alias("errors"), F.count_if(F.col("error").isNull()).alias("n_results"),
    )


def combine(lexical: Column, enforcing: Column) -> Column:
    return F.greatest(lexical, enforcing)


def merge(scanned: DataFrame, combined: DataFrame, results: DataFrame, registrations: DataFrame, *, threshold: float = 0.6, id_col: str = "doc_id") -> DataFrame:
    """scanned (risk, patterns, blocked) with the ensemble's score merged in and `detector:<name>` for each enforcing one that adds."""
    joined = registered(results, registrations).where((F.col("mode") == ENFORCING) & (F.col("score") >= F.col("threshold")) & (F.col("score") * F.col("weight") > 0))
    names = joined.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_set("detector")), lambda n: F.concat(F.lit("detector:"), n)).alias("_names"))
    out = scanned.join(combined.select(id_col, "enforcing_score"), id_col, "left").join(names, id_col, "left")
    out = out.withColumn("risk", F.greatest("risk", F.coalesce("enforcing_score", F.lit(0.0)))).withColumn("blocked", F.col("blocked") | (F.col("risk") >= threshold))
    return out.withColumn("patterns", F.concat("patterns", F.coalesce("_names", F.array().cast("array<string>")))).drop("_names", "enforcing_score")
