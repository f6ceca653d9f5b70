"""Budgets, risk and nonces over streaming tables, with the state of each key in Spark's state store."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textward.operators.sessions import Limits

LATE = "2 minutes"


def _stateful(rows: DataFrame, key: str, step, out: str, state: str, ttl_ms: int) -> DataFrame:
    """step(rows in order of ts and id, state or None) gives (output rows, state[, how long to hold the state in ms])."""

    def one(k, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        frame, new, *hold = step(k[0], pdf, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutDuration(max(ttl_ms, *hold) if hold else ttl_ms)
        yield frame

    return rows.groupBy(key).applyInPandasWithState(one, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def budgets(events: DataFrame, *, most: int = Limits.requests, window_s: int = Limits.window_s) -> DataFrame:
    """(session_id, id, count, limited) of events (session_id, id, ts in seconds): how many of the trailing window, this one included."""

    def step(session, pdf: pd.DataFrame, held):
        times = list(held[0]) if held else []
        out = []
        for r in pdf.itertuples():
            times = [t for t in times if t > r.ts - window_s] + [float(r.ts)]
            out.append((session, r.id, len(times), len(times) > most))
        return pd.DataFrame(out, columns=["session_id", "id", "count", "limited"]), (times,)

    return _stateful(events, "session_id", step, "session_id string, id long, count long, limited boolean", "times array<double>", 1000 * max(window_s, 1))


def risk(updates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, id, risk, flagged) of updates (session_id, id, ts in seconds, delta)."""

    def step(session, pdf: pd.DataFrame, held):
        value, last, flagged = held if held else (0.0, None, False)
        out = []
        for r in pdf.itertuples():
            if last is not None and r.ts - last >= limits.ttl_s:
                value, flagged, last = 0.0, False, None
            value = (0.0 if last is None else max(0.0, value - (r.ts - last) * limits.decay_per_s)) + r.delta
            flagged, last = flagged or value >= limits.risk, float(r.ts)
            out.append((session, r.id, value, flagged))
        return pd.DataFrame(out, columns=["session_id", "id", "risk", "flagged"]), (float(value), last, bool(flagged))

    return _stateful(updates, "session_id", step, "session_id string, id long, risk double, flagged boolean", "risk double, last double, flagged boolean", 1000 * limits.ttl_s)


def nonces(uses: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """(nonce, id, use_number, allowed) of uses (nonce, id, ts, max_uses and, where there is one, expires_at in seconds).

    A nonce is known for ttl_s after its last use, and until its token expires: a use that comes later is refused as expired.
    """
    expiring = "expires_at" in uses.columns

    def step(nonce, pdf: pd.DataFrame, held):
        n = held[0] if held else 0
        numbers = list(range(n + 1, n + 1 + len(pdf)))
        frame = pd.DataFrame({"nonce": nonce, "id": pdf["id"].to_numpy(), "use_number": numbers, "allowed": [k <= m for k, m in zip(numbers, pdf["max_uses"], strict=True)]})
        if not expiring:
            return frame, (n + len(pdf),)
        frame["allowed"] &= (pdf["ts"] <= pdf["expires_at"]).to_numpy()
        last = float(pdf["expires_at"].max())
        # by the clock and by the events, whichever is longer: an event's time may lag behind the clock
        left = max(last - time.time(), last - float(pdf["ts"].max()), 0.0) if math.isfinite(last) else 0.0
        return frame, (n + len(pdf),), int(1000 * left) + 1000

    return _stateful(uses, "nonce", step, "nonce string, id long, use_number long, allowed boolean", "uses long", 1000 * ttl_s)


def single_use(uses: DataFrame, ts: str = "event_time") -> DataFrame:
    """The first use of each nonce within the watermark: replay protection for tokens of one use."""
    return uses.withWatermark(ts, LATE).dropDuplicatesWithinWatermark(["nonce"])


def active_sessions(events: DataFrame, ts: str = "event_time", limits: Limits = Limits()) -> DataFrame:
    """Sessions by pauses of ttl_s: (session_id, window, events); rows later than the watermark are dropped."""
    gap = F.session_window(ts, f"{limits.ttl_s} seconds")
    return events.withWatermark(ts, LATE).groupBy("session_id", gap).agg(F.count(F.lit(1)).alias("events"))
