"""Input scan: injection phrases, hidden and encoded text, look-alike letters, bidi overrides, and their risk score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import text as T
from textward.functions.patterns import Pattern, Registry


@dataclass(frozen=True)
class Weights:
    """What each signal adds to the score."""

    pattern: float = 0.25
    pattern_most: float = 0.75
    encoded: float = 0.4
    hidden: float = 0.4
    bidi: float = 0.2
    languages: float = 0.15
    lookalikes: float = 0.4


def phrase_names(text: Column, lowered: Column, patterns: dict[str, Pattern], prefix: str = "") -> Column:
    """Names of the patterns that match, in order. A pattern runs only where a literal of it occurs."""
    found = []
    for p in patterns.values():
        hit = text.rlike(p.java())
        if p.flags == ("IGNORECASE",) and len(p.literal()) >= 3:
            hit = lowered.contains(p.literal()) & hit
        found.append(F.when(hit, F.lit(prefix + p.name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _lowered(text: Column) -> Column:
    """For the literals: letters that match i and s regardless of case become them."""
    return F.lower(F.when(T.beyond_ascii(text), F.translate(text, "İıſ", "iis")).otherwise(text))


def _each(texts: Column, patterns: dict[str, Pattern], prefix: str) -> Column:
    """Names found in each of several texts, which mostly are none."""
    ready = F.transform(texts, lambda t: F.struct(T.strip_invisible(t).alias("t"), _lowered(T.strip_invisible(t)).alias("low")))
    names = F.transform(ready, lambda x: phrase_names(x["t"], x["low"], patterns, prefix))
    return F.when(F.size(texts) > 0, F.flatten(names)).otherwise(F.array().cast("array<string>"))


def languages(names: Column, patterns: dict[str, Pattern]) -> Column:
    """Distinct languages of matched names, sorted."""
    if not patterns:
        return F.array().cast("array<string>")
    of = F.create_map(*[F.lit(x) for p in patterns.values() for x in (p.name, p.lang)])
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: F.element_at(of, F.regexp_replace(n, r"^\[(hidden|decoded)\] ", "")))))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed here, once: a Generate stands between, so later uses don't repeat them in their code."""
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(one)).alias("_c")).select(*kept, "_c.*")


def scan(
    df: DataFrame, text_col: str = "text", *, registry: Registry | None = None, weights: Weights = Weights(), threshold: Column | float = 0.6, max_chars: int | None = T.MAX_SCAN_CHARS, tag: str = "USER_DATA", prefix: str = ""
) -> DataFrame:
    """df with the columns (all led by prefix) normalized, wrapped, patterns, languages, decoded, hidden,
    lookalikes, oversized, risk (rounded), blocked.

    Texts over max_chars aren't read: risk 1.0, the pattern `oversized_input`, blocked.  A null text
    scans as an empty one.
    """
    patterns = (registry or Registry()).injection
    c = lambda name: F.col(f"`{prefix}{name}`")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    over = F.length(raw) > max_chars if max_chars else F.lit(False)
    read = F.when(over, F.lit("")).otherwise(raw)
    folded, count = T.fold_lookalikes(F.col("_read"))
    out = df.withColumn("_read", read).withColumn(f"{prefix}oversized", over)
    out = out.withColumn("_folded", folded).withColumn(f"{prefix}lookalikes", count)
    out = out.withColumn("_bidi", F.col("_read").rlike(T.BIDI_OVERRIDE)).withColumn(f"{prefix}hidden", T.hidden_text(F.col("_read")))
    out = out.withColumn(f"{prefix}normalized", T.normalize(F.col("_folded")))
    out = out.withColumn(f"{prefix}decoded", T.encoded_payloads(c("normalized"))).withColumn("_lower", _lowered(c("normalized")))
    # texts recovered from hiding are normalized like visible ones
    seen = phrase_names(c("normalized"), F.col("_lower"), patterns)
    names = F.concat(seen, _each(c("hidden"), patterns, "[hidden] "), _each(c("decoded"), patterns, "[decoded] "))
    out = computed(out, _names=names).withColumn(f"{prefix}languages", languages(F.col("_names"), patterns))
    w = weights
    score = F.least(F.size("_names") * w.pattern, F.lit(w.pattern_most))
    for signal, weight in ((F.size(c("decoded")) > 0, w.encoded), (F.size(c("hidden")) > 0, w.hidden), (F.col("_bidi"), w.bidi), (c("lookalikes") > 0, w.lookalikes), (F.size(c("languages")) > 1, w.languages)):
        score = score + F.when(signal, weight).otherwise(0.0)
    out = out.withColumn("_score", F.when(c("oversized"), 1.0).otherwise(F.least(score, F.lit(1.0))))
    extra = F.when(c("lookalikes") > 0, F.array(F.lit("mixed_script_homoglyphs"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn(f"{prefix}patterns", F.when(c("oversized"), F.array(F.lit("oversized_input"))).otherwise(F.concat("_names", extra)))
    out = out.withColumn(f"{prefix}risk", F.bround("_score", 2)).withColumn(f"{prefix}blocked", c("oversized") | (F.col("_score") >= threshold))
    out = out.withColumn(f"{prefix}wrapped", T.wrap_as_data(c("normalized"), tag))
    return out.drop("_read", "_folded", "_bidi", "_lower", "_names", "_score")
