"""Spans in texts: where patterns match, which of overlapping ones count, and texts with them replaced.

A span is a struct (start, end, category, priority) in code points. Finding them is the one step
that Spark's functions can't express (they give matched texts, not places); it is an Arrow UDF. The
rest folds over arrays inside the row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.patterns import CARD, PHONE, Registry

SPANS = "array<struct<start:int,end:int,category:string,priority:int>>"
SECRET, PERSONAL = 0, 1
FOREIGN = "cross_tenant_identifier"
CANARY = "system_prompt_canary"
_NOT_DIGIT = re.compile(r"\D")


def luhn(number: str) -> bool:
    """Whether at least 13 digits sum to a multiple of 10, every second from the right doubled."""
    digits = [int(d) for d in _NOT_DIGIT.sub("", number)]
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return len(digits) >= 13 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def find_in(text: str, secrets: list, personal: list, literals: list[str] = (), canaries: tuple[str, ...] = ()) -> list[tuple[int, int, str, int]]:
    """All spans of one text: secret patterns, literals and canaries first, then personal data."""
    out = [(*m.span(), name, SECRET) for name, p in secrets for m in p.finditer(text) if m.group()]
    for kind, words in ((FOREIGN, literals), (CANARY, canaries)):
        out += [(*m.span(), kind, SECRET) for w in words for m in re.finditer(re.escape(w), text)]
    out += [(*m.span(), name, PERSONAL) for name, p in personal for m in p.finditer(text) if m.group()]
    if personal is not None:
        out += [(*m.span(), "credit_card", PERSONAL) for m in _CARD.finditer(text) if luhn(m.group())]
        for m in _PHONE.finditer(text):
            raw = m.group()
            if len(_NOT_DIGIT.sub("", raw)) >= 8:
                left = m.start() + len(raw) - len(raw.lstrip())
                out.append((left, left + len(raw.strip()), "phone_candidate", PERSONAL))
    return out


_CARD, _PHONE = re.compile(CARD), re.compile(PHONE)


def compiled(registry: Registry) -> tuple[list, list]:
    return [(n, p.python()) for n, p in registry.secrets.items()], [(n, p.python()) for n, p in registry.pii.items()]


def find(text: Column, registry: Registry, literals: Column | None = None, canaries: tuple[str, ...] = ()) -> Column:
    """Spans of secrets and personal data; null texts have none."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series, words: pd.Series) -> pd.Series:
        secrets, personal = compiled(registry)
        return pd.Series([[] if t is None else [dict(zip(("start", "end", "category", "priority"), s)) for s in find_in(t, secrets, personal, [] if w is None else list(w), canaries)] for t, w in zip(texts, words, strict=True)])

    return spans(text, F.lit(None).cast("array<string>") if literals is None else literals)


def of_priority(spans: Column, priority: int) -> Column:
    return F.filter(spans, lambda s: s["priority"] == priority)


def resolve(spans: Column) -> Column:
    """Disjoint spans in order of start: of two that overlap, the earlier, unless the later is longer."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("minus"), s["priority"].alias("priority"), s["category"].alias("category"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,minus:int,priority:int,category:string,end:int>>")

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        before = F.slice(kept, 1, F.size(kept) - 1)
        return (
            F.when((F.size(kept) == 0) | (s["start"] >= last["end"]), F.concat(kept, F.array(s)))
            .when(s["minus"] < last["minus"], F.concat(before, F.array(s)))
            .otherwise(kept)
        )

    return F.aggregate(F.array_sort(keyed), empty, step)


def replace(text: Column, spans: Column, by) -> Column:
    """Text with each of disjoint spans replaced; by: column of a span to column."""

    def step(done: Column, s: Column) -> Column:
        return F.struct(F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), by(s)).alias("out"), s["end"].alias("at"))

    end = F.aggregate(F.array_sort(spans), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text))))


def redact(text: Column, spans: Column) -> Column:
    return replace(text, resolve(spans), lambda s: F.concat(F.lit("[REDACTED:"), F.upper(s["category"]), F.lit("]")))


def findings(text: Column, spans: Column) -> Column:
    """Matched texts by category, categories and texts in order of start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["category"].alias("category"), s["end"].alias("end"))))
    kinds = F.array_distinct(F.transform(ordered, lambda s: s["category"]))
    return F.map_from_entries(
        F.transform(kinds, lambda k: F.struct(k.alias("key"), F.transform(F.filter(ordered, lambda s: s["category"] == k), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("value")))
    )


def literal_spans(text: Column, literals: Column, category: str = FOREIGN) -> Column:
    """Places of literals, without Python: running offsets over the parts between them."""

    def places(word: Column) -> Column:
        parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        step = lambda acc, p: F.struct(F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"), (acc["at"] + F.length(p) + F.length(word)).alias("at"))
        ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")), step)["out"]
        return F.transform(ends, lambda a: F.struct(a.alias("start"), (a + F.length(word)).alias("end"), F.lit(category).alias("category"), F.lit(SECRET).alias("priority")))

    return F.flatten(F.transform(literals, places))
