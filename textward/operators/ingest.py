"""Ingest of documents: verdicts by trust tier, provenance records, checks at retrieval, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textward.functions.text import content_hash, wrap_as_data
from textward.operators import exfil, scan

ACCEPT, QUARANTINE, REJECT = "accept", "quarantine", "reject"
# From which score a tier's documents are held for review, and from which refused.
TIERS = {"trusted": (0.75, 0.95), "partner": (0.5, 0.8), "untrusted": (0.25, 0.6)}
DEFAULT_TIER = "untrusted"
RECORD = "document_id string, content_hash string, source_id string, trust string, decision string, risk_score double, recorded_at timestamp"


def thresholds(trust: Column, tiers: dict[str, tuple[float, float]] = TIERS) -> tuple[Column, Column]:
    """(quarantine, reject) of a tier; an unknown tier fails the query."""
    unknown = F.raise_error(F.concat(F.lit("no thresholds for trust tier "), trust))
    pair = []
    for k in (0, 1):
        value = F.lit(None).cast("double")
        for name, limits in tiers.items():
            value = F.when(trust == name, F.lit(limits[k])).otherwise(value)
        pair.append(F.when(trust.isin(*tiers), value).otherwise(unknown.cast("double")))
    return pair[0], pair[1]


def verdicts(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "content", trust_col: str = "trust", tiers: dict[str, tuple[float, float]] = TIERS, policy: exfil.Policy = exfil.Policy(), shadow: bool = False, **options) -> DataFrame:
    """docs with the scan's columns and content_hash, trust, reasons, risk_score, decision, would_decide.

    A null trust is the default tier.  In shadow mode every decision is to accept, and would_decide tells the real one.
    """
    trust = F.coalesce(F.col(trust_col), F.lit(DEFAULT_TIER)) if trust_col in docs.columns else F.lit(DEFAULT_TIER)
    out = docs.withColumn("trust", trust)
    hold, refuse = thresholds(F.col("trust"), tiers)
    out = scan.scan(out, text_col, threshold=hold, tag="EXTERNAL_CONTENT", **options)
    out = out.withColumn("exfil", exfil.find(F.coalesce(F.col(text_col), F.lit("")), policy))
    sus = F.size(exfil.suspicious(F.col("exfil"))) > 0
    score = F.when(sus, F.greatest("risk", F.when(exfil.blocked(F.col("exfil")), 0.8).otherwise(0.5))).otherwise(F.col("risk"))
    signs = ((F.size("patterns") > 0, "injection_phrases"), (F.size("decoded") > 0, "encoded_payload"), (F.size("hidden") > 0, "hidden_text"), (sus, "exfil_url"))
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in signs])))
    out = out.withColumn("risk_score", F.bround(score, 2)).withColumn("content_hash", content_hash(F.coalesce(F.col(text_col), F.lit(""))))
    decided = F.when(F.col("risk_score") >= refuse, REJECT).when(F.col("risk_score") >= hold, QUARANTINE).otherwise(ACCEPT)
    out = out.withColumn("would_decide", decided)
    return out.withColumn("decision", F.lit(ACCEPT) if shadow else F.col("would_decide"))


def records(judged: DataFrame, recorded_at: Column, *, id_col: str = "document_id", source_col: str = "source_id", keep_rejected: bool = True) -> DataFrame:
    out = judged.select(F.col(id_col).cast("string").alias("document_id"), "content_hash", F.col(source_col).alias("source_id"), "trust", "decision", "risk_score", recorded_at.cast("timestamp").alias("recorded_at"))
    return out if keep_rejected else out.where(F.col("decision") == ACCEPT)


def latest(history: DataFrame) -> DataFrame:
    """The last record of each document (of equal times the one with the greatest hash)."""
    rest = [c for c in history.columns if c not in ("document_id", "recorded_at")]
    last = history.groupBy("document_id").agg(F.max(F.struct("recorded_at", *rest)).alias("r"))
    return last.select("document_id", *[F.col(f"r.{c}") for c in history.columns if c != "document_id"])


def upsert(provenance: DataFrame, new: DataFrame) -> DataFrame:
    return latest(provenance.unionByName(new))


def decide(provenance: DataFrame, reviewed: DataFrame) -> DataFrame:
    """provenance with the decisions of reviewed (document_id, decision); unknown documents add nothing."""
    one = reviewed.groupBy("document_id").agg(F.max("decision").alias("_new"))
    return provenance.join(one, "document_id", "left").withColumn("decision", F.coalesce("_new", "decision")).drop("_new")


def verify(retrieved: DataFrame, provenance: DataFrame, *, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """retrieved with trusted and reason: no_provenance_record, content_hash_mismatch, ingested_as_..., verified."""
    known = provenance.select(F.col("document_id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("decision").alias("_decision"))
    out = retrieved.join(known, F.col(id_col).cast("string") == F.col("_id"), "left")
    now = content_hash(F.coalesce(F.col(text_col), F.lit("")))
    reason = (
        F.when(F.col("_id").isNull(), "no_provenance_record").when(F.col("_hash") != now, "content_hash_mismatch")
        .when(F.col("_decision") != ACCEPT, F.concat(F.lit("ingested_as_"), F.col("_decision"))).otherwise("verified")
    )
    return out.withColumn("reason", reason).withColumn("trusted", F.col("reason") == "verified").drop("_id", "_hash", "_decision")


def never_ingested(retrieved: DataFrame, provenance: DataFrame, id_col: str = "document_id") -> DataFrame:
    ids = provenance.select(F.col("document_id").alias("_id"))
    return retrieved.join(ids, F.col(id_col).cast("string") == F.col("_id"), "left_anti")


def retrievable(scanned: DataFrame, provenance: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Rows that the scan doesn't block and whose provenance verifies (those without an id only need the scan)."""
    checked = verify(scanned, provenance, id_col=id_col, text_col=text_col)
    return checked.where(~F.col("blocked") & (F.col("trusted") | F.col(id_col).isNull()))


def context(retrieved: DataFrame, provenance: DataFrame, *, id_col: str = "document_id", text_col: str = "content", **options) -> DataFrame:
    """The rows of retrieved that may stand in a prompt (`retrievable`), with risk and context: the normalized text, marked as data."""
    scanned = scan.scan(retrieved, text_col, tag="RETRIEVED_DOCUMENT", prefix="_scan_", **options).withColumn("blocked", F.col("_scan_blocked"))
    kept = retrievable(scanned, provenance, id_col, text_col)
    return kept.select(*[F.col(f"`{c}`") for c in retrieved.columns if c not in ("risk", "context")], F.col("_scan_risk").alias("risk"), wrap_as_data(F.col("_scan_normalized"), "RETRIEVED_DOCUMENT").alias("context"))


def review_queue(provenance: DataFrame, limit: int = 100) -> DataFrame:
    """Documents held for review, oldest first."""
    return provenance.where(F.col("decision") == QUARANTINE).orderBy("recorded_at", "document_id").limit(limit)


def versions(history: DataFrame) -> DataFrame:
    """history with each record's number within its document, in order of time."""
    return history.withColumn("version", F.row_number().over(Window.partitionBy("document_id").orderBy("recorded_at", "content_hash")))
