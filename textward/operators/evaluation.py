"""How well scores tell attacks from benign texts: sweeps over thresholds, recommendation, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ATTACK, BENIGN = "attack", "benign"
THRESHOLDS = tuple(round(k / 20, 2) for k in range(1, 21))


def sweep(scored: DataFrame, *, by: list[str] | None = None, label: str = "label", score: str = "score", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A row for each threshold (and group): tp, fp, tn, fn, precision, recall, fpr, f1.

    Rows are first counted by the number of thresholds they reach, so nothing is multiplied by the thresholds.
    Null scores (errors) aren't counted.
    """
    by, grid = by or [], sorted(thresholds)
    reached = sum((F.col(score) >= t).cast("int") for t in grid)
    counts = scored.where(F.col(score).isNotNull()).groupBy(*by, (F.col(label) == ATTACK).alias("_attack"), reached.alias("_reached")).count()
    each = counts.select(*by, "_attack", "_reached", "count", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("_k", "threshold"))
    total = lambda attack, flagged: F.coalesce(F.sum(F.when((F.col("_attack") == attack) & ((F.col("_reached") > F.col("_k")) == flagged), F.col("count"))), F.lit(0))
    out = each.groupBy(*by, "threshold").agg(total(True, True).alias("tp"), total(False, True).alias("fp"), total(False, False).alias("tn"), total(True, False).alias("fn"))
    return metrics(out)


def metrics(counts: DataFrame) -> DataFrame:
    """counts with precision, recall (1 without cases), fpr and f1 (0 without)."""
    share = lambda a, b, none: F.when(a + b == 0, F.lit(none)).otherwise(a / (a + b))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("precision", share(tp, fp, 1.0)).withColumn("recall", share(tp, fn, 1.0)).withColumn("fpr", share(fp, tn, 0.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def recommend(swept: DataFrame, *, by: list[str] | None = None, max_fpr: float = 0.01) -> DataFrame:
    """The lowest threshold within the budget of false positives, else the lowest of the least rate."""
    fits = F.col("fpr") <= max_fpr
    key = F.struct((~fits).alias("over"), F.when(fits, 0.0).otherwise(F.col("fpr")).alias("rate"), F.col("threshold").alias("t"))
    best = swept.groupBy(*(by or [])).agg(F.min_by(F.struct(*[c for c in swept.columns if c not in (by or [])]), key).alias("b"))
    return best.select(*(by or []), "b.*")


def misclassified(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """scored rows judged wrongly, with kind: missed or false_alarm."""
    attack, flagged = F.col(label) == ATTACK, F.col(score) >= threshold
    return scored.where(attack != flagged).withColumn("kind", F.when(attack, "missed").otherwise("false_alarm"))


def promotion(scored: DataFrame, *, signal: str = "signal", label: str = "label", score: str = "score", max_fpr: float = 0.01, baseline: str = "lexical") -> DataFrame:
    """For each signal its recommended threshold, recall, fpr, scored, errored, and verdict against the baseline."""
    sizes = scored.groupBy(signal).agg(F.count(F.col(score)).alias("scored"), F.count_if(F.col(score).isNull()).alias("errored"))
    best = recommend(sweep(scored, by=[signal], label=label, score=score), by=[signal], max_fpr=max_fpr).select(signal, "threshold", "recall", "fpr")
    # a row for each signal: few enough for one window
    base = F.max(F.when(F.col(signal) == baseline, F.col("recall"))).over(Window.partitionBy(F.lit(0)))
    out = sizes.join(best, signal, "left").withColumn("_base", base)
    verdict = (
        F.when(F.col("scored") == 0, "no data").when(F.col(signal) == baseline, "baseline").when(F.col("fpr") > max_fpr, "over budget")
        .when(F.col("recall") > F.col("_base"), "gains recall").otherwise("no gain")
    )
    return out.withColumn("verdict", verdict).withColumn("gain", F.col("recall") - F.col("_base")).drop("_base")


def report(swept: DataFrame) -> DataFrame:
    """One row, the column report: a line for each threshold."""
    line = F.format_string("%.2f  tp=%d fp=%d tn=%d fn=%d  precision=%.3f recall=%.3f fpr=%.3f f1=%.3f", "threshold", "tp", "fp", "tn", "fn", "precision", "recall", "fpr", "f1")
    lines = F.array_sort(F.collect_list(F.struct("threshold", line.alias("line"))))
    return swept.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


def attack_label(flag: Column) -> Column:
    return F.when(flag, F.lit(ATTACK)).otherwise(F.lit(BENIGN))
