"""Signed capability tokens as columns: issue, parse, verify, authorize, attenuate.

A token is hex(payload JSON) + "." + HMAC-SHA256 of the payload's bytes in hex. Signatures are checked over
the bytes received.
"""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.functions.text import hmac_sha256
from textward.operators.scan import computed

log = logging.getLogger(__name__)
MAX_CHARS = 16_384
MAX_DEPTH = 8
MIN_KEY = 32
REQUIRED = ("agent_id", "scopes", "expires_at", "nonce", "max_uses", "kid")
# The alphabets of key ids and audiences.
KID = r"\A[A-Za-z0-9._:-]{1,64}\z"
AUDIENCE = r"\A[A-Za-z0-9._:/-]{1,128}\z"
PAYLOAD = T.StructType(
    [
        T.StructField("agent_id", T.StringType()), T.StructField("aud", T.StringType()), T.StructField("constraints", T.MapType(T.StringType(), T.StringType())),
        T.StructField("depth", T.IntegerType()), T.StructField("expires_at", T.DoubleType()), T.StructField("issued_at", T.DoubleType()), T.StructField("kid", T.StringType()),
        T.StructField("max_uses", T.IntegerType()), T.StructField("nonce", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("scopes", T.ArrayType(T.StringType())),
        T.StructField("subject", T.StringType()),
    ]
)


def named(alphabet: str, name: object) -> bool:
    return isinstance(name, str) and re.fullmatch(alphabet.removeprefix(r"\A").removesuffix(r"\z"), name) is not None


@dataclass(frozen=True)
class Keyring:
    """Signing keys by id, of which one is active."""

    keys: dict[str, bytes]
    active: str

    def __post_init__(self) -> None:
        if self.active not in self.keys:
            raise ValueError(f"the active key {self.active!r} is not on the ring")
        if odd := [k for k in self.keys if not named(KID, k)]:
            raise ValueError(f"no valid key ids: {odd}")
        if short := [k for k, v in self.keys.items() if len(v) < MIN_KEY]:
            raise ValueError(f"keys under {MIN_KEY} bytes: {short}")

    def with_key(self, kid: str, key: bytes) -> Keyring:
        return replace(self, keys=self.keys | {kid: key})

    def with_active(self, kid: str) -> Keyring:
        return replace(self, active=kid)

    def without_key(self, kid: str) -> Keyring:
        return replace(self, keys={k: v for k, v in self.keys.items() if k != kid})

    def sign(self, raw: Column, kid: Column | None = None) -> Column:
        """Signature of bytes under the named key (else the active one); null for an unknown one."""
        kid = F.lit(self.active) if kid is None else kid
        out = F.lit(None).cast("string")
        for name, key in self.keys.items():
            out = F.when(kid == name, hmac_sha256(raw, key)).otherwise(out)
        return out


class Keys:
    """A ring that its provider hands out anew every reload_s seconds; while the provider fails, the last good ring stays."""

    def __init__(self, provider: Callable[[], Keyring], reload_s: float = 60.0, clock: Callable[[], float] = time.monotonic) -> None:
        if reload_s <= 0:
            raise ValueError("reload_s is positive")
        self.provider, self.reload_s, self.clock = provider, reload_s, clock
        self.error: str | None = None
        self._ring, self._read = self._fresh(), clock()

    def _fresh(self) -> Keyring:
        ring = self.provider()
        if not isinstance(ring, Keyring):
            raise TypeError(f"a provider of keys returned {type(ring).__name__}")
        return ring

    @property
    def ring(self) -> Keyring:
        """The ring for plans that are made now; a plan keeps the ring it was made with."""
        if self.clock() - self._read >= self.reload_s:
            self.reload()
        return self._ring

    def reload(self) -> None:
        """Ask the provider now; error tells why that failed, None if it didn't."""
        self._read = self.clock()
        try:
            self._ring, self.error = self._fresh(), None
        except Exception as e:  # noqa: BLE001 - the last good ring stays
            self.error = f"{type(e).__name__}: {e}"
            log.warning("keys were not reloaded, %r stays active: %s", self._ring.active, self.error)


def payload_json(**fields: Column) -> Column:
    """An object with sorted keys and all fields, nulls too."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def encode(json_text: Column, ring: Keyring) -> Column:
    raw = json_text.cast("binary")
    return F.concat(F.lower(F.hex(raw)), F.lit("."), ring.sign(raw))


def issue(df: DataFrame, ring: Keyring, *, agent_id: Column, scopes: Column, issued_at: Column, nonce: Column, ttl_s: Column | int = 300, max_uses: Column | int = 1, subject: Column | None = None, constraints: Column | None = None, audience: str | None = None) -> DataFrame:
    """df with the column token; issued_at in seconds."""
    if audience is not None and not named(AUDIENCE, audience):
        raise ValueError(f"no valid audience: {audience!r}")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = payload_json(
        agent_id=agent_id, scopes=F.array_sort(F.array_distinct(scopes)), issued_at=issued_at.cast("double"), expires_at=(issued_at + lit(ttl_s)).cast("double"), nonce=nonce, max_uses=lit(max_uses),
        subject=F.lit(None).cast("string") if subject is None else subject, constraints=F.create_map().cast("map<string,string>") if constraints is None else constraints, kid=F.lit(ring.active), aud=F.lit(audience).cast("string"),
    )
    return df.withColumn("token", encode(text, ring))


def parse(df: DataFrame, token_col: str = "token") -> DataFrame:
    """df with raw (bytes), signature, payload (struct) and malformed (why the token can't be read, else null).

    They are `computed` here, so a filter on them reads them and doesn't parse the token anew for each mention of it.
    """
    token = F.col(token_col)
    at = F.instr(token, ".")
    head, tail = F.when(at > 0, F.substring(token, F.lit(1), at - 1)), F.when(at > 0, F.substring(token, at + 1, F.length(token)))
    hexed = head.rlike(r"\A(?:[0-9a-fA-F]{2})+\z")
    out = df.withColumn("raw", F.when((F.length(token) <= MAX_CHARS) & hexed, F.unhex(head))).withColumn("signature", tail)
    text = F.try_validate_utf8(F.col("raw"))
    out = out.withColumn("payload", F.from_json(text, PAYLOAD)).withColumn("_missing", F.lit(""))
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), F.json_object_keys(text))
    # fields that stand there, but as null or as something else than their type or alphabet
    p = lambda name: F.col(f"payload.{name}")
    good = {k: p(k).isNotNull() for k in REQUIRED}
    good["scopes"] = good["scopes"] & F.forall(p("scopes"), lambda x: x.isNotNull())
    good["expires_at"] = F.abs(p("expires_at")) < float("inf")
    good["kid"] = p("kid").rlike(KID)
    good["aud"] = p("aud").isNull() | p("aud").rlike(AUDIENCE)
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in good.items()]))
    why = (
        F.when(token.isNull(), "not_a_string").when(F.length(token) > MAX_CHARS, "too_long")
        .when((at <= 1) | (tail == ""), "no_signature").when(~hexed, "not_hex")
        .when(text.isNull(), "not_json").when(F.json_object_keys(text).isNull(), "not_an_object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_"), F.array_join(missing, "_")))
        .when(F.size(bad) > 0, F.concat(F.lit("bad_"), F.array_join(bad, "_")))
    )
    out = out.withColumn("malformed", why).drop("_missing")
    return computed(out, **{c: F.col(c) for c in ("raw", "signature", "payload", "malformed")})


def authorize(calls: DataFrame, ring: Keyring, *, action: str = "action", subject: str = "subject", now: str = "now", audience: str | None = None, require_subject: bool = False, revocations: DataFrame | None = None) -> DataFrame:
    """parsed calls with denied: the first check that fails, null if none; replay is checked after (`sessions.nonce_uses`).

    A check that can't be answered, for a null action, time, scope or anything else, has failed.

    Order: form, key, signature, audience, subject, expiry, scope, revocation (subject, revoked_at, expires_at).
    """
    p = F.col("payload")
    out = calls.withColumn("_expected", ring.sign(F.col("raw"), p["kid"]))
    if revocations is not None:
        gone = revocations.groupBy(F.col("subject").alias("_subject"), F.col("expires_at").alias("_until")).agg(F.max("revoked_at").alias("_revoked"))
        gone = gone.groupBy("_subject").agg(F.max(F.struct("_revoked", "_until")).alias("_gone"))
        out = out.join(gone, p["subject"] == F.col("_subject"), "left")
    else:
        out = out.withColumn("_subject", F.lit(None).cast("string")).withColumn("_gone", F.lit(None).cast("struct<_revoked:double,_until:double>"))
    bound = p["subject"].isNotNull()
    revoked = F.coalesce((F.col("_gone._until") > F.col(now)) & (F.coalesce(p["issued_at"], F.lit(0.0)) <= F.col("_gone._revoked")), F.lit(False))
    checks = [
        (F.col("malformed").isNotNull(), "malformed"),
        (p["kid"].isNull() | ~F.coalesce(p["kid"].isin(*ring.keys), F.lit(False)), "unknown_key"),
        (F.col("_expected") != F.col("signature"), "bad_signature"),
    ]
    if audience is not None:
        checks += [(p["aud"].isNull(), "no_audience"), (p["aud"] != audience, "wrong_audience")]
    checks += [(bound & F.col(subject).isNull(), "no_subject"), (bound & (p["subject"] != F.col(subject)), "wrong_subject")]
    if require_subject:
        checks.append((~bound, "unbound"))
    checks += [(F.col(now) > p["expires_at"], "expired"), (~F.array_contains(p["scopes"], F.col(action)), "out_of_scope"), (bound & revoked, "revoked")]
    return out.withColumn("denied", F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in checks])).drop("_expected", "_subject", "_gone")


def constraints_met(constraints: Column, actual: Column) -> Column:
    """Whether each constraint is supplied with an equal value (maps of strings)."""
    keys = F.map_keys(F.coalesce(constraints, F.create_map().cast("map<string,string>")))
    return F.forall(keys, lambda k: F.coalesce(F.element_at(actual, k) == F.element_at(constraints, k), F.lit(False)))


def attenuate(parents: DataFrame, *, scopes: str = "want_scopes", uses: str = "want_uses", ttl: str = "want_ttl", constraints: str = "want_constraints", now: str = "now") -> DataFrame:
    """Parents (payload columns flat) with refused (the first rule a request breaks, else null), and the child's
    child_scopes, child_uses, child_expires_at, child_depth and child_constraints."""
    wanted = F.array_sort(F.array_distinct(F.col(scopes)))
    asked = F.coalesce(F.col(uses), F.col("max_uses"))
    nothing = F.create_map().cast("map<string,string>")
    own, extra = F.coalesce(F.col("constraints"), nothing), F.coalesce(F.col(constraints), nothing)
    changed = F.exists(F.map_keys(extra), lambda k: F.map_contains_key(own, k) & (F.element_at(own, k) != F.element_at(extra, k)))
    depth = F.coalesce(F.col("depth"), F.lit(0)) + 1
    rules = [
        (F.coalesce(F.col(now) > F.col("expires_at"), F.lit(True)), "expired"), (depth > MAX_DEPTH, "too_deep"), (F.coalesce(F.size(F.array_except(wanted, F.col("scopes"))), F.lit(1)) > 0, "wider_scope"),
        (F.size(wanted) == 0, "no_scope"), (F.col(ttl) <= 0, "bad_ttl"), (F.coalesce((asked < 1) | (asked > F.col("max_uses")), F.lit(True)), "too_many_uses"), (changed, "changed_constraint"),
    ]
    until = F.least("expires_at", F.coalesce(F.col(now) + F.col(ttl), F.col("expires_at")))
    only = F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k))
    return (
        parents.withColumn("refused", F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules])).withColumn("child_scopes", wanted).withColumn("child_uses", asked)
        .withColumn("child_expires_at", until).withColumn("child_depth", depth).withColumn("child_constraints", F.map_concat(own, only))
    )


def attenuated(parents: DataFrame, ring: Keyring, *, child_nonce: Column, now: str = "now", **wanted: str) -> DataFrame:
    """parents (payload columns flat) with `attenuate`'s columns and child_token, null where the request is refused.

    The child is signed with the active key and keeps the agent, subject and audience of its parent, whose nonce it names.
    """
    out = attenuate(parents, now=now, **wanted)
    have = lambda name: F.col(name) if name in parents.columns else F.lit(None).cast("string")
    text = payload_json(
        agent_id=have("agent_id"), scopes=F.col("child_scopes"), issued_at=F.col(now).cast("double"), expires_at=F.col("child_expires_at").cast("double"), nonce=child_nonce, max_uses=F.col("child_uses"),
        subject=have("subject"), constraints=F.col("child_constraints"), kid=F.lit(ring.active), aud=have("aud"), parent=have("nonce"), depth=F.col("child_depth"),
    )
    return out.withColumn("child_token", F.when(F.col("refused").isNull(), encode(text, ring)))


def chain_depth(tokens: DataFrame, nonce: str = "nonce", parent: str = "parent", most: int = MAX_DEPTH) -> DataFrame:
    """(nonce, root, links): the first token of each token's chain and how far it is; chains over `most` links have no root."""
    up = tokens.select(F.col(nonce).alias("_n"), F.col(parent).alias("_up"))
    now = tokens.select(F.col(nonce).alias(nonce), F.col(nonce).alias("_at"), F.col(parent).alias("_next"), F.lit(0).alias("links"))
    for _ in range(most):
        now = now.join(up, F.col("_next") == F.col("_n"), "left").select(
            nonce, F.coalesce("_n", "_at").alias("_at"), F.when(F.col("_n").isNotNull(), F.col("_up")).alias("_next"), (F.col("links") + F.col("_n").isNotNull().cast("int")).alias("links")
        )
    return now.select(nonce, F.when(F.col("_next").isNull(), F.col("_at")).alias("root"), "links")
