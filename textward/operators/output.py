"""Output scan: secrets and personal data, share of a system prompt reproduced, redaction and blocking."""

from __future__ import annotations

import secrets
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions import text as T
from textward.functions.patterns import Registry
from textward.operators import exfil
from textward.operators import spans as S

OVERLAP = 0.35
# What stands in the place of an answer.
TOO_LARGE = "[Response withheld by the security layer: too large to scan safely.]"
BLOCKED = "[Response blocked by the security layer: possible credential or system-prompt leak detected.]"
EXFIL_BLOCKED = "[Response blocked by the security layer: it contained a URL that would have transmitted data to a third party when rendered.]"


@dataclass(frozen=True)
class Canary:
    """A marker that nothing but a system prompt holds: an answer with it has reproduced the prompt."""

    token: str

    @classmethod
    def generate(cls, prefix: str = "CANARY") -> Canary:
        """A new marker: letters only, so that it is no number of any kind."""
        return cls(f"{prefix}-" + "".join(secrets.choice(string.ascii_uppercase) for _ in range(24)))

    def plant(self, prompt: str) -> str:
        return f"{prompt}\n\n[internal marker {self.token}: means nothing, is never to be written out]"

    def planted(self, prompt: Column) -> Column:
        """`plant` as a column."""
        return F.concat(prompt, F.lit(self.plant("")))


def categories(text: Column, group: dict) -> Column:
    """Names of the patterns of a group that match, sorted: Catalyst only."""
    hits = [F.when(text.rlike(p.java()), F.lit(n)) for n, p in group.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def overlap(output: Column, prompt: Column) -> Column:
    """Share of the prompt's distinctive words that the output has, to three digits."""
    words = T.distinctive_tokens(F.coalesce(prompt, F.lit("")))
    share = F.size(F.array_intersect(words, T.tokens(output))) / F.size(words)
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.bround(share, 3))


def scan(df: DataFrame, text_col: str = "text", *, prompt_col: str | None = None, literals_col: str | None = None, registry: Registry | None = None, threshold: float = OVERLAP, max_chars: int | None = T.MAX_SCAN_CHARS, canaries: tuple[Canary, ...] = ()) -> DataFrame:
    """df with redacted, secrets, pii (maps of texts by category), overlap, blocked, oversized.

    A secret (a canary is one), or an overlap of at least the threshold, blocks; personal data doesn't.  Null texts scan as empty.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    over = F.length(raw) > max_chars if max_chars else F.lit(False)
    out = df.withColumn("oversized", over).withColumn("_read", F.when(over, F.lit("")).otherwise(raw))
    literals = T.forbidden_literals(F.col(literals_col)) if literals_col else None
    out = out.withColumn("_spans", S.find(F.col("_read"), registry or Registry(), literals, tuple(c.token for c in canaries)))
    out = out.withColumn("overlap", overlap(F.col("_read"), F.col(prompt_col)) if prompt_col else F.lit(0.0))
    secret, personal = S.of_priority(F.col("_spans"), S.SECRET), S.of_priority(F.col("_spans"), S.PERSONAL)
    out = out.withColumn("redacted", F.when(F.col("oversized"), F.lit(TOO_LARGE)).otherwise(S.redact(F.col("_read"), F.col("_spans"))))
    out = out.withColumn("secrets", S.findings(F.col("_read"), secret)).withColumn("pii", S.findings(F.col("_read"), personal))
    out = out.withColumn("blocked", F.col("oversized") | (F.size(secret) > 0) | (F.col("overlap") >= threshold))
    return out.drop("_read", "_spans")


def answer(df: DataFrame, text_col: str = "text", *, policy: exfil.Policy = exfil.Policy(), shadow: bool = False, urls: bool = True, **options) -> DataFrame:
    """The whole check of a model's answer: `scan`, URLs in the redacted text, reason and safe text.

    Adds exfil (findings), would_block, reason, safe_text; blocked is false in shadow mode, which lets the text through.
    Without urls they aren't looked for.
    """
    out = scan(df, text_col, **options).withColumnRenamed("blocked", "_hit")
    out = out.withColumn("exfil", exfil.find(F.when(~F.col("oversized") if urls else F.lit(False), F.col("redacted")), policy))
    url = exfil.blocked(F.col("exfil"))
    out = out.withColumn("would_block", F.col("_hit") | url)
    reason = (
        F.when(F.col("oversized"), "oversized").when(F.size(F.map_keys("secrets")) > 0, "secret").when(url, "exfil")
        .when(F.col("overlap") > 0, "system_prompt_overlap").otherwise("none")
    )
    safe = (
        F.when(F.col("oversized"), F.col("redacted"))
        .when(~F.col("would_block"), exfil.neutralize(F.col("redacted"), F.col("exfil")))
        .when(url & ~F.col("_hit"), F.lit(EXFIL_BLOCKED))
        .otherwise(F.lit(BLOCKED))
    )
    out = out.withColumn("reason", reason).withColumn("safe_text", F.col(text_col) if shadow else safe)
    return out.withColumn("blocked", F.lit(False) if shadow else F.col("would_block")).drop("_hit")
