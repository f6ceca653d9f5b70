"""What becomes of a check whose backend doesn't answer: policies, breakers, calls of bounded time.

`replay` runs breakers over a table of past calls; `Guarded` runs one around a function inside a Python worker
(each worker keeps its own, as each process of a service would).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSED = "open", "closed"
# What an operation does without its backend, unless told otherwise; seconds and numbers of calls.
DECISIONS = {"token_replay": CLOSED, "provenance": CLOSED, "rate_limit": OPEN, "session_risk": OPEN, "audit": OPEN, "detector": OPEN}
TIMEOUT_S, FAILURES, RECOVERY_S = 2.0, 5, 10.0


@dataclass(frozen=True)
class Policy:
    """By operation: open lets through what can't be checked, closed refuses it."""

    decisions: dict[str, str] = field(default_factory=dict)
    timeout_s: float | None = TIMEOUT_S
    failures: int = FAILURES
    recovery_s: float = RECOVERY_S

    def __post_init__(self) -> None:
        if odd := {k: v for k, v in self.decisions.items() if k not in DECISIONS or v not in (OPEN, CLOSED)}:
            raise ValueError(f"operations are {list(DECISIONS)}, each {OPEN} or {CLOSED}, not {odd}")
        if self.timeout_s is not None and self.timeout_s <= 0 or self.failures < 1 or self.recovery_s <= 0:
            raise ValueError("timeout_s (or None) and recovery_s are positive, failures at least 1")

    @classmethod
    def all(cls, decision: str, **options) -> Policy:
        return cls(dict.fromkeys(DECISIONS, decision), **options)

    def decision(self, operation: str) -> str:
        if operation not in DECISIONS:
            raise ValueError(f"no operation {operation!r}; there are {list(DECISIONS)}")
        return (DECISIONS | self.decisions)[operation]

    def decided(self, operation: Column) -> Column:
        """`decision` as a column; null for an unknown operation."""
        known = DECISIONS | self.decisions
        return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), operation)


class Breaker:
    """Opens once so many calls have failed, for recovery_s; then lets calls through until one fails.

    Failures add up: a good answer does not take them back, unless resets is set.
    """

    def __init__(self, failures: int = FAILURES, recovery_s: float = RECOVERY_S, resets: bool = False) -> None:
        self.failures, self.recovery_s, self.resets = failures, recovery_s, resets
        self.failed, self.opened = 0, None

    def state(self, now: float) -> str:
        if self.opened is None:
            return "closed" if self.failed < self.failures else "half_open"
        return "open" if now - self.opened < self.recovery_s else "half_open"

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.opened, self.failed = None, 0 if self.resets else self.failed
            return
        self.failed += 1
        if self.failed >= self.failures:
            self.opened = now


def replay(calls: DataFrame, policy: Policy = Policy(), *, key: str = "operation", ts: str = "ts", order: str = "call_id", ok: str = "ok", resets: bool = False) -> DataFrame:
    """(key, order, state, made, failed): each key's breaker before the call, whether the call was made, failures counted after it.

    ts is in seconds. Calls that an open breaker keeps back count for nothing, whatever their ok says; a null ok is a
    failure, a call of no time is kept out. A key's calls pass through one task in order, a batch at a time: nothing of
    a key is gathered. Equal rows stay apart, in any order among themselves.
    """
    rows = calls.where(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(ts).cast("double").alias("_ts"), F.coalesce(F.col(ok), F.lit(False)).alias("_ok"))
    names = rows.select(F.col("_key").alias(key), F.col("_order").alias(order)).schema
    schema = T.StructType([*names, T.StructField("state", T.StringType()), T.StructField("made", T.BooleanType()), T.StructField("failed", T.LongType())])
    failures, recovery_s = policy.failures, policy.recovery_s

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, breaker = object(), Breaker(failures, recovery_s, resets)
        for frame in frames:
            out = []
            for k, now, good in zip(frame["_key"], frame["_ts"], frame["_ok"]):
                k = None if pd.isna(k) else k
                if k != at:
                    at, breaker = k, Breaker(failures, recovery_s, resets)
                state = breaker.state(now)
                if state != "open":
                    breaker.record(bool(good), now)
                out.append((state, state != "open", breaker.failed))
            yield pd.DataFrame({key: frame["_key"], order: frame["_order"]}).assign(**{n: [r[i] for r in out] for i, n in enumerate(("state", "made", "failed"))})

    return rows.repartition("_key").sortWithinPartitions("_key", "_ts", "_order").mapInPandas(fold, schema)


def degraded(replayed: DataFrame, calls: DataFrame, policy: Policy = Policy(), *, key: str = "operation", order: str = "call_id", ok: str = "ok") -> DataFrame:
    """replayed with ok of its call and decision: what the policy makes of a call that failed or wasn't made, null for a good one."""
    both = replayed.join(calls.select(key, order, F.coalesce(F.col(ok), F.lit(False)).alias(ok)), [key, order])
    return both.withColumn("decision", F.when(~(F.col("made") & F.col(ok)), policy.decided(F.col(key))))


class TimedOut(Exception):
    pass


def bounded(fn: Callable, *args, seconds: float | None):
    """fn(*args), or TimedOut; a function that doesn't end keeps its thread, but the task goes on."""
    if seconds is None:
        return fn(*args)
    box: list = []

    def run() -> None:
        try:
            box.append((True, fn(*args)))
        except Exception as e:  # noqa: BLE001 - handed to the caller
            box.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimedOut(f"no answer in {seconds} s")
    good, value = box[0]
    if good:
        return value
    raise value


class Guarded:
    """A function whose calls are bounded in time and kept back while its breaker is open."""

    def __init__(self, fn: Callable, policy: Policy = Policy(), clock: Callable[[], float] = time.monotonic) -> None:
        self.fn, self.policy, self.clock = fn, policy, clock
        self.breaker = Breaker(policy.failures, policy.recovery_s)

    def __call__(self, *args):
        if self.breaker.state(self.clock()) == "open":
            raise TimedOut("not called: its breaker is open")
        try:
            out = bounded(self.fn, *args, seconds=self.policy.timeout_s)
        except Exception:
            self.breaker.record(False, self.clock())
            raise
        self.breaker.record(True, self.clock())
        return out
