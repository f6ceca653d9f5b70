"""Budgets and risk of sessions and actors, use counts of nonces, latest revocations: ordered folds as windows.

Budgets look back a bounded time, so a key's events are cut into stretches of many windows' length,
each with the events of the window before it for context: a key with very many events is
spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Limits:
    window_s: int = 60
    requests: int = 30
    tool_calls: int = 15
    risk: float = 1.5
    decay_per_s: float = 0.02
    ttl_s: int = 3600
    actor_risk: float = 3.0
    actor_ttl_s: int = 86400


#: Windows in a stretch.
STRETCH = 64


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_count(events: DataFrame, key: str, ts: str, order: str, window_s: int, out: str = "count") -> DataFrame:
    """events with how many of the key's events, up to this one, lie in (t - window, t].

    Of equal times, those of smaller order come first; ts is in microseconds.
    """
    width = window_s * 1_000_000
    stretch = F.floor(F.col(ts) / (width * STRETCH))
    tail = F.pmod(F.col(ts), F.lit(width * STRETCH)) >= width * (STRETCH - 1)
    places = F.when(tail, F.array(F.struct(stretch.alias("s"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("s"), F.lit(False).alias("own"))))
    places = places.otherwise(F.array(F.struct(stretch.alias("s"), F.lit(True).alias("own"))))
    cut = events.withColumn("_p", F.explode(places))
    by = Window.partitionBy(key, "_p.s").orderBy(ts).rangeBetween(-(width - 1), 0)
    peers = Window.partitionBy(key, "_p.s", ts)
    seen = F.count(F.lit(1)).over(by) - F.count(F.lit(1)).over(peers) + F.row_number().over(peers.orderBy(order))
    return cut.withColumn(out, seen.cast("long")).where("_p.own").drop("_p")


def over_budget(events: DataFrame, key: str, ts: str, order: str, window_s: int, most: int | Column) -> DataFrame:
    """events with count and limited; refused events count too. most: a number, or a column for limits of each row."""
    return sliding_count(events, key, ts, order, window_s).withColumn("limited", F.col("count") > most)


def decayed_risk(updates: DataFrame, key: str, ts: str, order: str, delta: str, *, decay: float, threshold: float, ttl_s: int, out: str = "risk", flag: str = "flagged") -> DataFrame:
    """updates with the key's risk after each, r = max(0, r - decay * elapsed) + delta, and a flag that stays
    once risk reaches the threshold. A pause of ttl_s or more starts anew.

    The fold in closed form: with D the running sum of deltas and t the time since the key's pause,
    r = (D - decay * t) - min over earlier updates of (D before it - decay * its t).
    """
    by = Window.partitionBy(key).orderBy(ts, order)
    gap = F.col(ts) - F.lag(ts).over(by)
    islands = updates.withColumn("_new", F.coalesce((gap >= ttl_s * 1_000_000).cast("int"), F.lit(0)))
    islands = islands.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_island").orderBy(ts, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = (F.col(ts) - F.first(ts).over(so_far)) / F.lit(1e6) * decay
    out_df = islands.withColumn("_d", F.sum(delta).over(so_far)).withColumn("_t", t)
    out_df = out_df.withColumn("_low", F.min(F.col("_d") - F.col(delta) - F.col("_t")).over(so_far))
    out_df = out_df.withColumn(out, F.col("_d") - F.col("_t") - F.col("_low"))
    out_df = out_df.withColumn(flag, F.max(F.col(out) >= threshold).over(so_far))
    return out_df.drop("_new", "_island", "_d", "_t", "_low")


def session_and_actor(updates: DataFrame, ts: str, order: str, delta: str, *, session: str = "session_id", actor: str = "actor_id", limits: Limits = Limits()) -> DataFrame:
    """updates with session_risk, actor_risk and flagged: the session's or the actor's. Rows without actor have its risk null."""
    out = decayed_risk(updates, session, ts, order, delta, decay=limits.decay_per_s, threshold=limits.risk, ttl_s=limits.ttl_s, out="session_risk", flag="_s")
    out = decayed_risk(out, actor, ts, order, delta, decay=limits.decay_per_s, threshold=limits.actor_risk, ttl_s=limits.actor_ttl_s, out="actor_risk", flag="_a")
    known = F.col(actor).isNotNull()
    out = out.withColumn("actor_risk", F.when(known, F.col("actor_risk")))
    return out.withColumn("flagged", F.col("_s") | (known & F.col("_a"))).drop("_s", "_a")


def worst_chunk(chunks: DataFrame, session: str, batch: str, risk: str) -> DataFrame:
    """The risk that a batch of chunks adds to its session: the greatest, where above 0."""
    return chunks.groupBy(session, batch).agg(F.max(risk).alias("risk_delta")).where("risk_delta > 0")


def nonce_uses(uses: DataFrame, nonce: str = "nonce", ts: str = "ts", order: str = "use_id", most: str = "max_uses") -> DataFrame:
    """uses with use_number and allowed, use_number at most max_uses."""
    n = F.row_number().over(Window.partitionBy(nonce).orderBy(ts, order))
    return uses.withColumn("use_number", n).withColumn("allowed", F.col("use_number") <= F.col(most))


def latest_revocations(revocations: DataFrame, subject: str = "subject") -> DataFrame:
    """The latest revocation of each subject; it never moves back."""
    return revocations.groupBy(subject).agg(F.max("revoked_at").alias("revoked_at"), F.max("expires_at").alias("expires_at"))


def limits_for(turns: DataFrame, table: DataFrame, defaults: Limits = Limits(), principal: str = "principal") -> DataFrame:
    """turns with max_requests and max_tool_calls of the principal, or the defaults."""
    known = table.select(F.col(principal).alias("_p"), F.col("max_requests").alias("_r"), F.col("max_tool_calls").alias("_t"))
    out = turns.join(known, F.col(principal) == F.col("_p"), "left")
    out = out.withColumn("max_requests", F.coalesce("_r", F.lit(defaults.requests))).withColumn("max_tool_calls", F.coalesce("_t", F.lit(defaults.tool_calls)))
    return out.drop("_p", "_r", "_t")


def live(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows of a state table that haven't expired: the sweep as a filter."""
    return rows.where(F.col(expires) > now)
