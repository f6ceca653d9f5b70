"""The checks of a conversation's turns and of tool calls, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions import text as T
from textward.operators import capability, exfil, scan, sessions
from textward.operators.sessions import Limits


def inputs(turns: DataFrame, *, text_col: str = "text", session: str = "session_id", principal: str | None = None, ts: str = "ts_us", order: str = "turn_id", threshold: float = 0.6, limits: Limits = Limits(), shadow: bool = False, detectors: DataFrame | None = None, principals: DataFrame | None = None, **options) -> DataFrame:
    """turns with the scan, budget and cumulative risk of their session, would_block, blocked and reason.

    Turns over budget are counted but add no risk.  detectors: (order column, enforcing_score).  principals:
    (principal, max_requests, max_tool_calls), which take the place of the limits' requests.  options go to `scan.scan`.
    """
    key = T.session_key(F.col(session), F.col(principal)) if principal else F.col(session)
    out = scan.scan(turns, text_col, threshold=threshold, **options).withColumn("_key", key.cast("string"))
    if principals is not None:
        out = sessions.limits_for(out, principals, limits, principal)
    out = sessions.over_budget(out, "_key", ts, order, limits.window_s, limits.requests if principals is None else F.col("max_requests"))
    if detectors is not None:
        out = out.join(detectors.select(F.col(order), "enforcing_score"), order, "left")
        out = out.withColumn("combined_risk", F.greatest("risk", F.coalesce("enforcing_score", F.lit(0.0)))).drop("enforcing_score")
    else:
        out = out.withColumn("combined_risk", F.col("risk"))
    out = out.withColumn("_delta", F.when(F.col("limited"), 0.0).otherwise(F.col("combined_risk")))
    out = sessions.decayed_risk(out, "_key", ts, order, "_delta", decay=limits.decay_per_s, threshold=limits.risk, ttl_s=limits.ttl_s, out="session_risk", flag="session_flagged")
    hot = F.col("combined_risk") >= threshold
    out = out.withColumn("would_block", hot | F.col("blocked") | F.col("session_flagged") | F.col("limited"))
    reason = F.when(F.col("limited"), "rate_limit").when(F.col("oversized"), "oversized").when(hot, "risk_score").otherwise("session_risk")
    out = out.withColumn("reason", F.when(F.col("would_block"), reason)).withColumn("blocked", F.lit(False) if shadow else F.col("would_block"))
    return out.drop("_key", "_delta")


def tool_arguments(calls: DataFrame, args_col: str = "arguments", policy: exfil.Policy = exfil.Policy()) -> DataFrame:
    """calls (arguments in JSON) with urls: the suspicious ones in any string of the arguments."""
    return calls.withColumn("urls", exfil.find_values(F.col(args_col), policy))


def tool_results(results: DataFrame, result_col: str = "result", threshold: float = 0.6) -> DataFrame:
    """results (JSON) with the scan of all their strings, at most eight levels deep, joined by lines."""
    out = results.withColumn("_text", F.array_join(exfil.leaves(F.col(result_col), 8), "\n"))
    return scan.scan(out, "_text", threshold=threshold, tag="TOOL_RESULT").drop("_text")


def authorized_calls(calls: DataFrame, ring: capability.Keyring, *, args_col: str = "arguments", result_col: str | None = None, session: str = "session_id", ts: str = "ts_us", order: str = "call_id", limits: Limits = Limits(), policy: exfil.Policy = exfil.Policy(), threshold: float = 0.6, **checks) -> DataFrame:
    """calls with refused: the first of rate_limit, exfil_url, what `capability.authorize` denies, token_replayed; null for calls that go through.

    A call over the session's budget, or whose arguments hold a URL that blocks, isn't looked at further and uses
    up no token. With result_col (JSON), the results of calls that go through are scanned, and result_blocked tells of it.
    """
    out = sessions.over_budget(calls, session, ts, order, limits.window_s, limits.tool_calls)
    out = tool_arguments(out, args_col, policy)
    out = capability.authorize(capability.parse(out), ring, **checks)
    early = F.when(F.col("limited"), "rate_limit").when(F.exists("urls", lambda u: u["severity"] == "block"), "exfil_url")
    out = out.withColumn("refused", F.coalesce(early, F.col("denied"))).drop("denied", "raw", "signature", "count", "limited", "malformed")
    # only calls that got so far use a nonce, each token's in order
    nonce = F.when(F.col("refused").isNull(), F.col("payload.nonce")).otherwise(F.concat(F.lit("refused "), F.col(order).cast("string")))
    out = sessions.nonce_uses(out.withColumn("_nonce", nonce).withColumn("_most", F.col("payload.max_uses")), "_nonce", ts, order, "_most")
    replayed = F.col("refused").isNull() & ~F.coalesce(F.col("allowed"), F.lit(False))
    out = out.withColumn("refused", F.when(replayed, "token_replayed").otherwise(F.col("refused"))).drop("_nonce", "_most", "use_number", "allowed", "payload")
    if result_col:
        through = F.when(F.col("refused").isNull(), F.col(result_col))
        texts = F.array_join(exfil.leaves(through, 8), "\n")
        out = scan.scan(out.withColumn("_text", texts), "_text", threshold=threshold, tag="TOOL_RESULT", prefix="result_").drop("_text")
    return out
