"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least LEAST rows and more than one in SHARE of all; there are at most SHARE such keys.
SHARE = 256
LEAST = 256
SALTS = 64
#: Salts of joins that don't know their hot keys: tables with a row for each key are repeated so often.
FEW = 16


def hot(counts: DataFrame, key: str, n: str) -> list:
    """Values of a long key of the hot rows of a table with a row for each group, n of them: at most SHARE."""
    total = counts.agg(F.sum(n).alias("t")).first().t or 0
    return [r[0] for r in counts.where(F.col(n) >= max(LEAST, total // SHARE + 1)).select(key).collect()]


def salted(by: str | Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(7)), F.lit(salts)).cast("int")


def join(left: DataFrame, right: DataFrame, keys: list[str], *, hot: list, by: str) -> DataFrame:
    """Inner join on keys, with right's row of each key; rows of hot values of the first key are dealt by `by`, too."""
    if not hot:
        return left.join(right, keys)
    spread = F.col(keys[0]).isin(hot)
    left = left.withColumn("_salt", F.when(spread, salted(by, SALTS)).otherwise(0))
    every = F.when(spread, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("_salt", F.explode(every)).hint("merge"), [*keys, "_salt"]).drop("_salt")


def spread(left: DataFrame, right: DataFrame, keys: list[str], *, by: str, how: str = "inner", salts: int = FEW) -> DataFrame:
    """join on keys with right's row of each key, repeated so that any key's rows of left go to several tasks."""
    left = left.withColumn("_salt", salted(by, salts))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # merged: what is repeated here looks smaller to Spark's own size check than it is
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
