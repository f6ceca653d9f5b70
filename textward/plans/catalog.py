"""Registered queries and, where SQL can express them, their equivalents for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions import text as T
from textward.functions.patterns import CARD, Registry
from textward.operators import audit, capability, detectors, evaluation, exfil, foreign, ingest, media, metrics, output, resilience, scan, sessions
from textward.operators import spans as S
from textward.plans import planted, turns
from textward.plans.planted import quoted
from textward.streaming import output as streamed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one of texts that comes in fewer splits than there are cores is dealt over them, as scans cost far more than that."""
    out = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "conversations") and out.rdd.getNumPartitions() < cores:
        return out.repartition(cores)
    return out


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.expr(planted.DOCUMENT).alias("text"), F.expr(planted.TRUST).alias("trust"))


def conversation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(planted.TURN).alias("text"))


def joined(names: Column) -> Column:
    return F.array_join(names, ",")


# SQL building blocks. RE2 has no Unicode word ends and no look-ahead; explicit classes stand in.
_EDGE = r"[^\p{L}\p{N}_]"


def re2(regex: str, case: bool = True) -> str:
    if regex.startswith(r"\b"):
        regex = rf"(?:^|{_EDGE})" + regex[2:]
    if regex.endswith(r"\b"):
        regex = regex[:-2] + rf"(?:$|{_EDGE})"
    return quoted(("" if case else "(?i)") + regex)


_REGISTRY = Registry()
_LANGUAGE = {n: p.lang for n, p in _REGISTRY.injection.items()}


def names_sql(text: str, prefix: str = "") -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, {re2(p.regex, False)}) THEN '{prefix}{n}' END" for n, p in _REGISTRY.injection.items())
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


def languages_sql(names: str) -> str:
    case = " ".join(f"WHEN '{n}' THEN '{lang}'" for n, lang in _LANGUAGE.items())
    return f"list_sort(list_distinct(list_transform({names}, lambda x: CASE regexp_replace(x, '^\\[(hidden|decoded)\\] ', '') {case} END)))"


_TAGS = "".join(chr(0xE0000 + k) for k in range(1, 128))
_PLAIN = "".join(chr(k) for k in range(1, 128))
_STRIP = "regexp_replace({}, '[\\x{{E0000}}-\\x{{E007F}}\\x{{202A}}-\\x{{202E}}\\x{{200B}}-\\x{{200F}}]', '', 'g')"


def scan_sql(source: str) -> str:
    """CTEs up to `scanned` (patterns, languages, decoded, hidden, lookalikes, risk) over source, a relation with a column text."""
    lookalikes = quoted(T.LOOKALIKES)
    return f"""
    src AS ({source}),
    words AS (
        SELECT *, array_to_string(regexp_extract_all(text, '[\\x{{E0000}}-\\x{{E007F}}]'), '') AS tagged,
            regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS pieces
        FROM src
    ),
    folded AS (
        SELECT *, translate(tagged, {quoted(_TAGS)}, {quoted(_PLAIN)}) AS spelt,
            list_sum(list_transform(pieces, lambda w: CASE WHEN regexp_matches(w, '[A-Za-z]') THEN length(w) - length(translate(w, {lookalikes}, '')) ELSE 0 END)) AS lookalikes,
            {_STRIP.format(f"array_to_string(list_transform(pieces, lambda w: CASE WHEN regexp_matches(w, '[A-Za-z]') THEN translate(w, {lookalikes}, {quoted(T.LOOKALIKES_TO)}) ELSE w END), '')")} AS normalized
        FROM words
    ),
    found AS (
        SELECT *, CASE WHEN length(spelt) >= 3 THEN [spelt] ELSE [] END AS hidden,
            list_filter(regexp_extract_all(normalized, '[A-Za-z0-9+/=]{{24,}}'), lambda t: length(t) % 4 = 0 AND regexp_matches(t, '^[A-Za-z0-9+/]*={{0,2}}$')) AS b64,
            regexp_extract_all(normalized, '(?:[0-9a-fA-F]{{2}}){{12,}}') AS hx
        FROM folded
    ),
    decoded AS (
        SELECT *, list_transform(b64, lambda t: try(decode(from_base64(t)))) || list_transform(hx, lambda t: try(decode(unhex(t)))) AS plain FROM found
    ),
    named AS (
        SELECT *, {names_sql('normalized')}
            || flatten(list_transform(hidden, lambda h: {names_sql('h', '[hidden] ')}))
            || flatten(list_transform(list_filter(plain, lambda p: p IS NOT NULL), lambda h: {names_sql('h', '[decoded] ')})) AS names
        FROM decoded
    ),
    scored AS (
        SELECT *, {languages_sql('names')} AS languages,
            least(len(names) * 0.25, 0.75) + CASE WHEN len(b64) + len(hx) > 0 THEN 0.4 ELSE 0 END + CASE WHEN len(hidden) > 0 THEN 0.4 ELSE 0 END
            + CASE WHEN regexp_matches(text, '[\\x{{202D}}\\x{{202E}}]') THEN 0.2 ELSE 0 END + CASE WHEN lookalikes > 0 THEN 0.4 ELSE 0 END AS part
        FROM named
    ),
    scanned AS (
        SELECT *, round(least(part::DOUBLE + CASE WHEN len(languages) > 1 THEN 0.15 ELSE 0 END, 1.0), 2)::DOUBLE AS risk,
            names || CASE WHEN lookalikes > 0 THEN ['mixed_script_homoglyphs'] ELSE [] END AS patterns
        FROM scored
    )"""


_DOCS = f"SELECT doc_id, source, {planted.DOCUMENT} AS text, {planted.TRUST} AS trust FROM documents"
_TURNS = f"SELECT conv_id, turn, role, {planted.TURN} AS text FROM conversations"
# of the planted constructs, the image beacon blocks and the others are taken out
_EXFIL = "CASE WHEN regexp_matches(text, '!\\[p\\]\\(http://evil') THEN 0.8 WHEN regexp_matches(text, '\\[docs\\]\\(http://evil|<img src=\"https://cdn') THEN 0.5 ELSE 0 END"
_VERDICTS = f"""
    WITH {scan_sql(_DOCS)},
    lifted AS (SELECT *, greatest(risk, {_EXFIL})::DOUBLE AS risk_score, {_EXFIL} > 0 AS url FROM scanned),
    limits(trust, hold, refuse) AS (VALUES ('trusted', 0.75, 0.95), ('partner', 0.5, 0.8), ('untrusted', 0.25, 0.6)),
    verdicts AS (
        SELECT l.*, sha256(text) AS content_hash,
            CASE WHEN risk_score >= refuse THEN 'reject' WHEN risk_score >= hold THEN 'quarantine' ELSE 'accept' END AS decision,
            array_to_string(list_filter([CASE WHEN len(patterns) > 0 THEN 'injection_phrases' END, CASE WHEN len(b64) + len(hx) > 0 THEN 'encoded_payload' END,
                CASE WHEN len(hidden) > 0 THEN 'hidden_text' END, CASE WHEN url THEN 'exfil_url' END], lambda x: x IS NOT NULL), ',') AS reasons
        FROM lifted l JOIN limits USING (trust)
    )"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.verdicts(documents(spark, d), id_col="doc_id", text_col="text")


@query(f"{_VERDICTS} SELECT doc_id, trust, risk_score, decision, reasons, content_hash FROM verdicts")
def ingest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).select("doc_id", "trust", "risk_score", "decision", joined(F.col("reasons")).alias("reasons"), "content_hash")


@query(f"{_VERDICTS} SELECT source, decision, count(*) AS n, round(avg(risk_score), 6) AS avg_risk FROM verdicts GROUP BY source, decision")
def ingest_by_source(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).groupBy("source", "decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 6).alias("avg_risk"))


@query(f"WITH {scan_sql(_TURNS)} SELECT name, count(*) AS n FROM (SELECT unnest(patterns) AS name FROM scanned) GROUP BY name")
def injection_hits_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(conversation(spark, d)).select(F.explode("patterns").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {scan_sql(_TURNS)} SELECT conv_id, turn, array_to_string(languages, ',') AS languages, risk, risk >= 0.6 AS blocked FROM scanned")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(conversation(spark, d)).select("conv_id", "turn", joined(F.col("languages")).alias("languages"), "risk", "blocked")


@query(f"WITH {scan_sql(_DOCS)} SELECT doc_id, array_to_string(hidden, '') AS hidden, length(normalized) AS n_visible FROM scanned WHERE regexp_matches(text, '[\\x{{E0000}}-\\x{{E007F}}\\x{{202A}}-\\x{{202E}}]')")
def hidden_text_decode(spark: SparkSession, d: str) -> DataFrame:
    some = documents(spark, d).where(F.col("text").rlike(r"[\x{E0000}-\x{E007F}\x{202A}-\x{202E}]"))
    return scan.scan(some).select("doc_id", F.array_join("hidden", "").alias("hidden"), F.length("normalized").alias("n_visible"))


@query(f"WITH {scan_sql(_DOCS)} SELECT doc_id, lookalikes, right(normalized, 15) AS ending FROM scanned WHERE lookalikes > 0")
def lookalike_fold(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(documents(spark, d)).where("lookalikes > 0").select("doc_id", "lookalikes", F.expr("right(normalized, 15)").alias("ending"))


@query(f"WITH {scan_sql(_DOCS)} SELECT doc_id, len(b64) AS n_base64, len(hx) AS n_hex FROM scanned WHERE len(b64) + len(hx) > 0")
def encoded_payloads(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("normalized")
    found = scan.scan(documents(spark, d)).select("doc_id", F.size(T.base64_candidates(text)).alias("n_base64"), F.size(T.hex_candidates(text)).alias("n_hex"))
    return found.where("n_base64 + n_hex > 0")


@query(f"SELECT doc_id, sha256('<EXTERNAL_CONTENT>' || chr(10) || replace(text, '</EXTERNAL_CONTENT>', '') || chr(10) || '</EXTERNAL_CONTENT>') AS digest FROM ({_DOCS})")
def wrapped_data(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.sha2(T.wrap_as_data(F.col("text"), "EXTERNAL_CONTENT"), 256).alias("digest"))


_PLAIN_SECRETS = {n: p for n, p in _REGISTRY.secrets.items() if n != "generic_high_entropy_secret"}
_SECRETS_SQL = ", ".join(f"CASE WHEN regexp_matches(text, {re2(p.regex, 'IGNORECASE' not in p.flags)}) THEN '{n}' END" for n, p in _PLAIN_SECRETS.items())
_ENTROPY_SQL = f"CASE WHEN len(list_filter(regexp_extract_all(text, {re2(chr(92) + 'b[A-Za-z0-9+/=]{32,}' + chr(92) + 'b')[:-1]}[^' || chr(10) || ']*'), lambda s: regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]'))) > 0 THEN 'generic_high_entropy_secret' END"


def _categories(spark: SparkSession, d: str, group: dict) -> DataFrame:
    found = documents(spark, d).select(F.explode(output.categories(F.col("text"), group)).alias("category"))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT category, count(*) AS n FROM (SELECT unnest([{_SECRETS_SQL}, {_ENTROPY_SQL}]) AS category FROM ({_DOCS})) WHERE category IS NOT NULL GROUP BY category")
def secret_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d, _REGISTRY.secrets)


_EMAIL_SQL = r"(?:^|[^\p{L}\p{N}_])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}(?:$|[^\p{L}\p{N}_])"


@query(
    f"SELECT category, count(*) AS n FROM (SELECT unnest([CASE WHEN regexp_matches(text, '{_EMAIL_SQL}') THEN 'email' END, "
    f"CASE WHEN regexp_matches(text, {re2(_REGISTRY.pii['it_codice_fiscale'].regex)}) THEN 'it_codice_fiscale' END]) AS category FROM ({_DOCS})) WHERE category IS NOT NULL GROUP BY category"
)
def pii_categories(spark: SparkSession, d: str) -> DataFrame:
    return _categories(spark, d, _REGISTRY.pii)


@query(f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(CARD)})) AS run FROM ({_DOCS})),
digits AS (SELECT doc_id, regexp_replace(run, '[^0-9]', '', 'g') AS digits FROM runs)
SELECT doc_id, digits, len(digits) >= 13 AND list_sum(list_transform(range(1, len(digits) + 1), lambda i:
    CASE WHEN (len(digits) - i) % 2 = 1 THEN CASE WHEN substr(digits, i::INT, 1)::INT > 4 THEN substr(digits, i::INT, 1)::INT * 2 - 9 ELSE substr(digits, i::INT, 1)::INT * 2 END
    ELSE substr(digits, i::INT, 1)::INT END)) % 10 = 0 AS valid
FROM digits""")
def luhn_cards(spark: SparkSession, d: str) -> DataFrame:
    runs = documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({CARD})"), F.lit(1))).alias("run"))
    return runs.select("doc_id", F.regexp_replace("run", "[^0-9]", "").alias("digits"), T.luhn(F.col("run")).alias("valid"))


@query()
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return output.scan(documents(spark, d)).select("doc_id", "redacted", "blocked", joined(F.map_keys("secrets")).alias("secrets"), joined(F.map_keys("pii")).alias("pii"))


_WORDS_SQL = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_STOP_SQL = "[" + ", ".join(quoted(w) for w in dict.fromkeys(T.STOPWORDS)) + "]"


@query(f"""
WITH prompts AS (
    SELECT conv_id, list_filter({_WORDS_SQL.format("text")}, lambda w: length(w) > 2 AND NOT list_contains({_STOP_SQL}, w)) AS asked
    FROM conversations WHERE role = 'system'
),
answers AS (SELECT conv_id, turn, {_WORDS_SQL.format("text")} AS said FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(asked) AS n_asked, len(list_intersect(asked, said)) AS n_said
FROM answers JOIN prompts USING (conv_id)""")
def prompt_overlap(spark: SparkSession, d: str) -> DataFrame:
    turns_ = table(spark, d, "conversations")
    asked = turns_.where("role = 'system'").select("conv_id", T.distinctive_tokens(F.col("text")).alias("asked"))
    said = turns_.where("role = 'assistant'").select("conv_id", "turn", T.tokens(F.col("text")).alias("said"))
    return said.join(asked, "conv_id").select("conv_id", "turn", F.size("asked").alias("n_asked"), F.size(F.array_intersect("asked", "said")).alias("n_said"))


@query(f"""
WITH hits AS (
    SELECT doc_id, unnest(list_filter([
        CASE WHEN regexp_matches(text, '!\\[p\\]\\(') THEN 'http://evil.example/x.png?d=aGVsbG8gd29ybGQgc2VjcmV0IHZhbHVl|markdown_image|block|encoded_payload,auto_fetch_with_parameters' END,
        CASE WHEN regexp_matches(text, '\\[docs\\]\\(') THEN 'http://evil.example/c/4f3a9b2c1d0e8f7a6b5c4d3e2f1a0b9c8d7e6f5a|markdown_link|neutralize|encoded_payload' END,
        CASE WHEN regexp_matches(text, '<img src="https://cdn') THEN 'https://cdn.example/x.png?id=7|html_img_src|neutralize|auto_fetch_with_parameters' END,
        CASE WHEN regexp_matches(text, '\\[home\\]') THEN 'https://ok.example/index.html|markdown_link|notice|' END,
        CASE WHEN regexp_matches(text, '!\\[logo\\]') THEN 'https://ok.example/logo.png|markdown_image|notice|' END], lambda x: x IS NOT NULL)) AS h
    FROM ({_DOCS})
)
SELECT doc_id, split_part(h, '|', 1) AS url, split_part(h, '|', 2) AS channel, split_part(h, '|', 3) AS severity, split_part(h, '|', 4) AS reasons FROM hits""")
def exfil_findings(spark: SparkSession, d: str) -> DataFrame:
    found = documents(spark, d).select("doc_id", F.explode(exfil.find(F.col("text"))).alias("f"))
    return found.select("doc_id", "f.url", "f.channel", "f.severity", joined(F.col("f.reasons")).alias("reasons"))


@query(f"""
SELECT doc_id, sha256(CASE
    WHEN regexp_matches(text, '!\\[p\\]\\(http://evil') THEN regexp_replace(text, '!\\[p\\]\\([^)]*\\)', '[embedded content removed by the security layer]')
    WHEN regexp_matches(text, '\\[docs\\]\\(http://evil') THEN regexp_replace(text, '\\[docs\\]\\([^)]*\\)', '[docs — link removed by the security layer]')
    ELSE regexp_replace(text, '<img src="https://cdn[^"]*"', '[embedded content removed by the security layer]') END) AS digest
FROM ({_DOCS}) WHERE regexp_matches(text, '\\]\\(http://evil|<img src="https://cdn')""")
def exfil_neutralized(spark: SparkSession, d: str) -> DataFrame:
    some = documents(spark, d).withColumn("f", exfil.find(F.col("text"))).where(F.size(exfil.suspicious(F.col("f"))) > 0)
    return some.select("doc_id", F.sha2(exfil.neutralize(F.col("text"), F.col("f")), 256).alias("digest"))


@query()
def exfil_pages(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select(F.explode(exfil.find(F.concat("html", F.expr(planted.signal("page_id"))))).alias("f"))
    return found.groupBy("f.channel", "f.severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH segments AS (SELECT page_id, unnest(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda s: length(s) > 0)) AS segment FROM pages),
chars AS (SELECT page_id, segment, unnest(string_split(segment, '')) AS c, length(segment) AS n FROM (SELECT DISTINCT * FROM segments)),
shares AS (SELECT page_id, segment, count(*)::DOUBLE / any_value(n) AS p FROM chars WHERE c <> '' GROUP BY page_id, segment, c)
SELECT page_id, segment, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM shares GROUP BY page_id, segment""")
def entropy_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda s: F.length(s) > 0)
    each = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(parts)).alias("segment"))
    return each.select("page_id", "segment", (F.round(T.entropy(F.col("segment")), 6) + F.lit(0.0)).alias("entropy"))


@query("""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    regexp_matches(url, '^[a-z]+://([^/?#]+\\.)?example\\.com([/?#]|$)') OR regexp_matches(url, '^[a-z]+://m\\.[^/?#]*example\\.net([/?#]|$)') AND NOT regexp_matches(url, '^[a-z]+://m\\.[^/?#]*[^.]example\\.net') AND FALSE AS allowed
FROM pages""")
def allowed_hosts(spark: SparkSession, d: str) -> DataFrame:
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), exfil.host_allowed(host, ["example.com"]).alias("allowed"))


# Provenance: two thirds of the documents were recorded; of the retrieved ones every fifth has changed since.
_RETRIEVED = f"SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END AS now FROM ({_DOCS})"
_PROVENANCE = f"{_VERDICTS}, provenance AS (SELECT doc_id, content_hash, decision, risk_score, doc_id % 97 AS age FROM verdicts WHERE doc_id % 7 <> 1), retrieved AS ({_RETRIEVED})"
_CHECKED = f"""{_PROVENANCE}, checked AS (
    SELECT r.doc_id, CASE WHEN p.doc_id IS NULL THEN 'no_provenance_record' WHEN p.content_hash <> sha256(r.now) THEN 'content_hash_mismatch'
        WHEN p.decision <> 'accept' THEN 'ingested_as_' || p.decision ELSE 'verified' END AS reason
    FROM retrieved r LEFT JOIN provenance p USING (doc_id))"""


def provenance(spark: SparkSession, d: str) -> DataFrame:
    when = F.timestamp_seconds(F.lit(1_700_000_000) - (F.col("doc_id") % 97) * 3600)
    return ingest.records(verdicts(spark, d).where("doc_id % 7 <> 1"), when, id_col="doc_id", source_col="source")


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).withColumn("text", F.expr("text || CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END"))


@query(f"{_CHECKED} SELECT doc_id, reason, reason = 'verified' AS trusted FROM checked")
def provenance_verify(spark: SparkSession, d: str) -> DataFrame:
    return ingest.verify(retrieved(spark, d), provenance(spark, d), id_col="doc_id", text_col="text").select("doc_id", "reason", "trusted")


@query(f"{_CHECKED} SELECT reason, count(*) AS n FROM checked GROUP BY reason")
def tampered(spark: SparkSession, d: str) -> DataFrame:
    checked = ingest.verify(retrieved(spark, d), provenance(spark, d), id_col="doc_id", text_col="text")
    return checked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_PROVENANCE} SELECT doc_id FROM retrieved WHERE doc_id NOT IN (SELECT doc_id FROM provenance)")
def never_ingested(spark: SparkSession, d: str) -> DataFrame:
    return ingest.never_ingested(retrieved(spark, d), provenance(spark, d), "doc_id").select("doc_id")


@query(f"{_CHECKED} SELECT doc_id FROM checked JOIN scanned USING (doc_id) WHERE reason = 'verified' AND risk < 0.6")
def retrievable(spark: SparkSession, d: str) -> DataFrame:
    return ingest.retrievable(scan.scan(retrieved(spark, d)), provenance(spark, d), "doc_id", "text").select("doc_id")


@query(f"""{_CHECKED} SELECT doc_id, risk, sha256('<RETRIEVED_DOCUMENT>' || chr(10) || replace(normalized, '</RETRIEVED_DOCUMENT>', '') || chr(10) || '</RETRIEVED_DOCUMENT>') AS digest
FROM checked JOIN scanned USING (doc_id) WHERE reason = 'verified' AND risk < 0.6""")
def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    """What of the retrieved documents goes into a prompt."""
    return ingest.context(retrieved(spark, d), provenance(spark, d), id_col="doc_id", text_col="text").select("doc_id", "risk", F.sha2("context", 256).alias("digest"))


@query(f"{_PROVENANCE} SELECT doc_id::VARCHAR AS document_id, risk_score FROM provenance WHERE decision = 'quarantine' ORDER BY age DESC, doc_id::VARCHAR LIMIT 20")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return ingest.review_queue(provenance(spark, d), 20).select("document_id", "risk_score")


@query(f"""{_PROVENANCE}, reviewed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS d FROM provenance WHERE decision = 'quarantine')
SELECT coalesce(r.d, p.decision) AS decision, count(*) AS n FROM provenance p LEFT JOIN reviewed r USING (doc_id) GROUP BY 1""")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    known = provenance(spark, d)
    reviewed = known.where("decision = 'quarantine'").select("document_id", F.expr("CASE WHEN cast(document_id as long) % 2 = 0 THEN 'accept' ELSE 'reject' END").alias("decision"))
    return ingest.decide(known, reviewed).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_PROVENANCE}, history AS (
    SELECT doc_id, content_hash, decision, 0 AS version FROM provenance UNION ALL SELECT doc_id, sha256(text || '!') AS content_hash, 'accept' AS decision, 1 AS version FROM ({_DOCS}) WHERE doc_id % 4 = 0)
SELECT doc_id::VARCHAR AS document_id, arg_max(content_hash, version) AS content_hash, arg_max(decision, version) AS decision FROM history GROUP BY doc_id""")
def provenance_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = documents(spark, d).where("doc_id % 4 = 0").select(
        F.col("doc_id").cast("string").alias("document_id"), T.content_hash(F.concat("text", F.lit("!"))).alias("content_hash"), F.col("source").alias("source_id"), "trust",
        F.lit("accept").alias("decision"), F.lit(0.0).alias("risk_score"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("recorded_at"),
    )
    return ingest.upsert(provenance(spark, d), new).select("document_id", "content_hash", "decision")


# Sessions: users of the event stream.
_EVENTS = "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("t", sessions.micros(F.col("ts")))


def _budget_sql(where: str, window_s: int, most: int) -> str:
    return f"""
WITH e AS ({_EVENTS} {where})
SELECT a.event_id, count(*) AS count, count(*) > {most} AS limited FROM e a JOIN e b
    ON a.user_id = b.user_id AND b.t > a.t - {window_s}::BIGINT * 1000000 AND (b.t < a.t OR b.t = a.t AND b.event_id <= a.event_id)
GROUP BY a.event_id"""


@query(_budget_sql("", 86400, 5))
def request_budget(spark: SparkSession, d: str) -> DataFrame:
    return sessions.over_budget(events(spark, d), "user_id", "t", "event_id", 86400, 5).select("event_id", "count", "limited")


@query(_budget_sql("WHERE event_type = 'purchase'", 604800, 3))
def tool_budget(spark: SparkSession, d: str) -> DataFrame:
    calls = events(spark, d).where("event_type = 'purchase'")
    return sessions.over_budget(calls, "user_id", "t", "event_id", 604800, 3).select("event_id", "count", "limited")


_DELTA = "CASE event_type WHEN 'error' THEN 0.5 WHEN 'purchase' THEN 0.25 ELSE 0.0 END"
_DECAY, _RISK, _TTL = 0.00001, 1.0, 172800


def _risk_sql(key: str, threshold: float, ttl: int) -> str:
    """The fold step by step, as a recursion over each key's events."""
    return f"""
    u AS (SELECT event_id, {key} AS k, t, {_DELTA} AS delta, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS i FROM ({_EVENTS})),
    fold AS (
        SELECT event_id, k, t, i, delta::DOUBLE AS risk, delta >= {threshold} AS flagged FROM u WHERE i = 1
        UNION ALL
        SELECT u.event_id, u.k, u.t, u.i,
            (CASE WHEN u.t - f.t >= {ttl} * 1000000::BIGINT THEN 0 ELSE greatest(0, f.risk - (u.t - f.t) / 1e6 * {_DECAY}) END + u.delta)::DOUBLE,
            (CASE WHEN u.t - f.t >= {ttl} * 1000000::BIGINT THEN FALSE ELSE f.flagged END) OR
            (CASE WHEN u.t - f.t >= {ttl} * 1000000::BIGINT THEN 0 ELSE greatest(0, f.risk - (u.t - f.t) / 1e6 * {_DECAY}) END + u.delta) >= {threshold}
        FROM fold f JOIN u ON u.k = f.k AND u.i = f.i + 1
    )"""


@query(f"WITH RECURSIVE {_risk_sql('user_id', _RISK, _TTL)} SELECT event_id, round(risk, 6) AS risk, flagged FROM fold")
def session_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("delta", F.expr(_DELTA).cast("double"))
    out = sessions.decayed_risk(rows, "user_id", "t", "event_id", "delta", decay=_DECAY, threshold=_RISK, ttl_s=_TTL)
    return out.select("event_id", F.round("risk", 6).alias("risk"), "flagged")


@query(
    f"WITH RECURSIVE {_risk_sql('user_id', 1.5, 172800)}, {_risk_sql('user_id % 5', 3.0, 604800).replace('u AS', 'u2 AS').replace('fold AS', 'fold2 AS').replace('FROM u WHERE', 'FROM u2 WHERE').replace('FROM fold f JOIN u ON', 'FROM fold2 f JOIN u2 u ON')} "
    "SELECT event_id, a.flagged OR b.flagged AS flagged FROM fold a JOIN fold2 b USING (event_id)"
)
def actor_or_session_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "t", F.expr(_DELTA).cast("double").alias("delta"), F.col("user_id").alias("session_id"), T.actor_key((F.col("user_id") % 5).cast("string")).alias("actor_id"))
    limits = sessions.Limits(risk=1.5, decay_per_s=_DECAY, ttl_s=172800, actor_risk=3.0, actor_ttl_s=604800)
    return sessions.session_and_actor(rows, "t", "event_id", "delta", limits=limits).select("event_id", "flagged")


@query(f"WITH e AS ({_EVENTS}), b AS (SELECT user_id, t // 86400000000 AS day, max({_DELTA})::DOUBLE AS risk_delta FROM e GROUP BY ALL) SELECT * FROM b WHERE risk_delta > 0")
def worst_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("day", F.expr("t div 86400000000")).withColumn("delta", F.expr(_DELTA).cast("double"))
    return sessions.worst_chunk(rows, "user_id", "day", "delta")


@query(f"""WITH e AS ({_EVENTS}), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 86400000000 THEN 1 ELSE 0 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(t) AS started, count(*) AS events FROM i GROUP BY user_id, island""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    by = events(spark, d).withColumn("ts", F.timestamp_micros("t")).groupBy("user_id", F.session_window("ts", "86400 seconds").alias("w"))
    return by.agg(F.count(F.lit(1)).alias("events")).select("user_id", F.unix_micros("w.start").alias("started"), "events")


@query("""WITH u AS (SELECT event_id, user_id % 50 AS nonce, 3 + user_id % 2 AS max_uses, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS use_number FROM events)
SELECT event_id, use_number, use_number <= max_uses AS allowed FROM u""")
def token_replay(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("nonce"), (F.lit(3) + F.col("user_id") % 2).alias("max_uses"))
    return sessions.nonce_uses(uses, order="event_id").withColumn("allowed", F.col("use_number") <= F.when(F.col("nonce") % 2 == 0, 3).otherwise(4)).select("event_id", "use_number", "allowed")


@query("SELECT user_id, max(epoch_us(ts)) AS revoked_at FROM events WHERE event_type = 'error' GROUP BY user_id")
def latest_revocations(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'error'").select("user_id", F.col("t").alias("revoked_at"), F.col("t").alias("expires_at"))
    return sessions.latest_revocations(rows, "user_id").select("user_id", "revoked_at")


# Tokens: one for each order, in ways that fail each check in turn.
RING = capability.Keyring({"k1": b"first-key-of-thirty-two-bytes-at-least", "k2": b"second-key-of-thirty-two-bytes-or-more"}, "k1")
_NOW = 1_000_000.0


def tokens(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    kind = F.col("o_orderkey") % 16
    rows = capability.issue(
        o, RING, agent_id=F.concat(F.lit("agent"), (F.col("o_custkey") % 9).cast("string")), scopes=F.array(F.lit("read"), F.lit("write")),
        issued_at=F.lit(_NOW) - F.when(kind == 1, 400.0).otherwise(100.0), nonce=F.col("o_orderkey").cast("string"), subject=F.when(kind != 2, F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string"))),
        constraints=F.create_map(F.lit("account"), (F.col("o_custkey") % 4).cast("string")), audience="svc",
    )
    token = F.col("token")
    broken = (
        F.when(kind == 3, F.regexp_replace(token, ".$", "x")).when(kind == 4, F.lit("nodot")).when(kind == 5, F.concat(F.lit("zz"), token)).when(kind == 6, F.lit("7b7d.00"))
        .when(kind == 7, F.lit("5b5d.00")).when(kind == 8, F.repeat(F.lit("a"), 17000)).when(kind == 9, F.lit(None).cast("string")).otherwise(token)
    )
    return rows.withColumn("token", broken).withColumn("action", F.when(kind == 10, "delete").otherwise("read")).withColumn("now", F.lit(_NOW)).withColumn(
        "subject", F.when(kind == 11, F.lit(None)).when(kind == 12, F.lit("someone")).otherwise(F.concat(F.lit("u"), (F.col("o_custkey") % 10).cast("string")))
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 16 WHEN 1 THEN 'expired' WHEN 2 THEN NULL WHEN 3 THEN 'bad_signature' WHEN 4 THEN 'malformed' WHEN 5 THEN 'malformed' WHEN 6 THEN 'malformed' WHEN 7 THEN 'malformed'
    WHEN 8 THEN 'malformed' WHEN 9 THEN 'malformed' WHEN 10 THEN 'out_of_scope' WHEN 11 THEN 'no_subject' WHEN 12 THEN 'wrong_subject' ELSE CASE WHEN o_custkey % 10 = 3 THEN 'revoked' END END AS denied
FROM orders""")
def token_authorize(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("u3", _NOW - 50, _NOW + 1000), ("u4", _NOW - 50, _NOW - 1), ("u5", _NOW - 200, _NOW + 1000)], "subject string, revoked_at double, expires_at double")
    calls = capability.parse(tokens(spark, d))
    return capability.authorize(calls, RING, audience="svc", revocations=gone).select("o_orderkey", "denied")


@query("""
SELECT CASE o_orderkey % 16 WHEN 4 THEN 'no_signature' WHEN 5 THEN 'not_hex' WHEN 6 THEN 'missing_agent_id_scopes_expires_at_nonce_max_uses_kid' WHEN 7 THEN 'not_an_object' WHEN 8 THEN 'too_long' WHEN 9 THEN 'not_a_string'
    ELSE 'well_formed' END AS form, count(*) AS n FROM orders GROUP BY 1""")
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    form = F.coalesce("malformed", F.lit("well_formed"))
    return capability.parse(tokens(spark, d)).groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 1 AS met FROM orders WHERE o_orderkey % 16 NOT IN (4, 5, 6, 7, 8, 9)")
def token_constraints(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("o_custkey") % 4).cast("string")
    actual = F.when(F.col("o_orderkey") % 3 == 1, F.create_map(F.lit("account"), F.lit("9"))).otherwise(F.create_map(F.lit("account"), own, F.lit("other"), F.lit("1")))
    parsed = capability.parse(tokens(spark, d)).where("malformed is null")
    return parsed.select("o_orderkey", capability.constraints_met(F.col("payload.constraints"), actual).alias("met"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'expired' WHEN 2 THEN 'too_deep' WHEN 3 THEN 'wider_scope' WHEN 4 THEN 'no_scope' WHEN 5 THEN 'too_many_uses' WHEN 6 THEN 'changed_constraint' END AS refused,
    least(1000000.0 + CASE o_orderkey % 8 WHEN 1 THEN -1 ELSE 200 END, 1000050.0) AS child_expires_at FROM orders""")
def token_attenuation(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("o_orderkey") % 8
    parents = table(spark, d, "orders").select(
        "o_orderkey", F.lit(_NOW).alias("now"), (F.lit(_NOW) + F.when(kind == 1, -1).otherwise(200)).alias("expires_at"), F.when(kind == 2, 8).otherwise(2).alias("depth"), F.array(F.lit("read"), F.lit("write")).alias("scopes"),
        F.lit(3).alias("max_uses"), F.create_map(F.lit("account"), F.lit("1")).alias("constraints"),
        F.when(kind == 3, F.array(F.lit("read"), F.lit("admin"))).when(kind == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("read"))).alias("want_scopes"),
        F.when(kind == 5, 4).otherwise(2).alias("want_uses"), F.lit(50).alias("want_ttl"),
        F.when(kind == 6, F.create_map(F.lit("account"), F.lit("2"))).otherwise(F.create_map(F.lit("region"), F.lit("eu"))).alias("want_constraints"),
    )
    return capability.attenuate(parents).select("o_orderkey", "refused", "child_expires_at")


@query("""
WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), p AS (SELECT n, CASE WHEN n % 8 = 0 THEN NULL ELSE n - 1 END AS up FROM t),
c(n, root, links) AS (SELECT n, n, 0 FROM p WHERE up IS NULL UNION ALL SELECT p.n, c.root, c.links + 1 FROM p JOIN c ON p.up = c.n)
SELECT n::VARCHAR AS nonce, root::VARCHAR AS root, links FROM c""")
def token_chain(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select("o_orderkey")
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keys.withColumn("_b", F.expr("o_orderkey div 4096"))
    sizes = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.col("_b"))
    ranked = ranked.join(sizes.select("_b", before.alias("_base")), "_b")
    n = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("o_orderkey")) - 1
    ids = ranked.select(n.alias("n"))
    chain = ids.select(F.col("n").cast("string").alias("nonce"), F.when(F.col("n") % 8 != 0, (F.col("n") - 1).cast("string")).alias("parent"))
    return capability.chain_depth(chain)


# Detectors and evaluation: labels of toxicity as attacks, scores from the texts' lengths.
_SCORE = "round((n_chars % 101) / 100.0 * CASE WHEN toxic = 1 THEN 1.0 ELSE 0.7 END, 4)::DOUBLE"
_SAMPLES = f"SELECT doc_id, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS label, {_SCORE} AS score FROM documents JOIN labels USING (doc_id)"
_GRID = "SELECT unnest([" + ", ".join(map(str, evaluation.THRESHOLDS)) + "])::DOUBLE AS threshold"


def samples(spark: SparkSession, d: str) -> DataFrame:
    score = F.round((F.col("n_chars") % 101) / F.lit(100.0) * F.when(F.col("toxic") == 1, 1.0).otherwise(0.7), 4)
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.select("doc_id", evaluation.attack_label(F.col("toxic") == 1).alias("label"), score.alias("score"))


def _sweep_sql(source: str, by: str = "") -> str:
    return f"""
    s AS ({source}), g AS ({_GRID}),
    counts AS (
        SELECT {by} threshold, count(*) FILTER (label = 'attack' AND score >= threshold) AS tp, count(*) FILTER (label <> 'attack' AND score >= threshold) AS fp,
            count(*) FILTER (label <> 'attack' AND score < threshold) AS tn, count(*) FILTER (label = 'attack' AND score < threshold) AS fn
        FROM s, g WHERE score IS NOT NULL GROUP BY {by} threshold
    ),
    rates AS (
        SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr FROM counts
    )"""


_ROUNDED = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr"


@query(f"WITH {_sweep_sql(_SAMPLES)} SELECT threshold, tp, fp, tn, fn, {_ROUNDED}, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM rates")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    swept = evaluation.sweep(samples(spark, d))
    return swept.select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f1")])


@query(f"WITH {_sweep_sql(_SAMPLES)} SELECT threshold, tp, fp, {_ROUNDED} FROM rates ORDER BY fpr > 0.05, CASE WHEN fpr <= 0.05 THEN 0 ELSE fpr END, threshold LIMIT 1")
def recommend_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = evaluation.recommend(evaluation.sweep(samples(spark, d)), max_fpr=0.05)
    return best.select("threshold", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr")])


@query(f"SELECT doc_id, CASE WHEN label = 'attack' THEN 'missed' ELSE 'false_alarm' END AS kind FROM ({_SAMPLES}) WHERE (label = 'attack') <> (score >= 0.5)")
def misclassified(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.misclassified(samples(spark, d), 0.5).select("doc_id", "kind")


# Four detectors over embeddings' components; one fails for every seventh vector.
_REGISTERED = [("a", "enforcing", 1.0, 0.2), ("b", "advisory", 0.8, 0.0), ("c", "enforcing", 0.5, 0.1), ("d", "advisory", 1.0, 0.5)]
_LONG = """
    long AS (
        SELECT vec_id, name AS detector, CASE WHEN name = 'c' AND vec_id % 7 = 0 THEN NULL ELSE abs(embedding[k]::DOUBLE) END AS score, CASE WHEN name = 'c' AND vec_id % 7 = 0 THEN 'down' END AS error
        FROM embeddings, (VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 4)) AS v(name, k)
    )"""


def detector_results(spark: SparkSession, d: str) -> DataFrame:
    down = F.col("vec_id") % 7 == 0
    each = [F.struct(F.lit(n).alias("detector"), F.abs(F.col("embedding")[k].cast("double")).alias("score")) for k, n in enumerate("abcd")]
    long = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*each)).alias("r")).select("vec_id", "r.*")
    fails = (F.col("detector") == "c") & down
    return long.withColumn("error", F.when(fails, "down")).withColumn("score", F.when(~fails, F.col("score")))


@query(f"""
WITH {_LONG}, r(detector, mode, weight, threshold) AS (VALUES {", ".join(map(str, _REGISTERED))}),
w AS (SELECT vec_id, detector, mode, error, CASE WHEN score < threshold THEN 0 ELSE score * weight END AS part FROM long JOIN r USING (detector))
SELECT vec_id, round(coalesce(max(part) FILTER (mode = 'enforcing' AND error IS NULL), 0), 9)::DOUBLE AS enforcing_score, round(coalesce(max(part) FILTER (mode = 'advisory' AND error IS NULL), 0), 9)::DOUBLE AS advisory_score,
    coalesce(string_agg(detector, ',' ORDER BY detector) FILTER (error IS NOT NULL), '') AS errors, count(*) FILTER (error IS NULL) AS n_results
FROM w GROUP BY vec_id""")
def detector_ensemble(spark: SparkSession, d: str) -> DataFrame:
    registered = spark.createDataFrame(_REGISTERED, "detector string, mode string, weight double, threshold double")
    out = detectors.ensemble(detector_results(spark, d), registered, "vec_id")
    return out.select("vec_id", F.round("enforcing_score", 9).alias("enforcing_score"), F.round("advisory_score", 9).alias("advisory_score"), joined(F.col("errors")).alias("errors"), "n_results")


# A detector that is down for some lengths of text and out of range for others.
@query("""
SELECT doc_id, 'length' AS detector, CASE WHEN n % 7 <> 0 AND n % 11 <> 0 THEN (n % 100) / 100 END AS score, CASE WHEN n % 7 <> 0 AND n % 11 <> 0 AND n % 2 = 0 THEN 'even' END AS label,
    CASE WHEN n % 7 = 0 THEN 'RuntimeError: down' WHEN n % 11 = 0 THEN 'score 2.0 is outside 0..1' END AS error
FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def detector_scores(spark: SparkSession, d: str) -> DataFrame:
    """A function of a text over all documents: its faults are errors of their rows."""

    def length(text: str):
        n = len(text)
        if n % 7 == 0:
            raise RuntimeError("down")
        score = 2.0 if n % 11 == 0 else n % 100 / 100
        return score if n % 2 else (score, "even")

    run = detectors.detector(length, resilience.Policy(timeout_s=None, failures=1 << 30))
    return detectors.score(table(spark, d, "documents"), {"length": run}).select("doc_id", "detector", "score", "label", "error")


_MERGED = [("tens", "enforcing", 0.9, 0.5), ("sevens", "advisory", 1.0, 0.0)]


@query(f"""
WITH {scan_sql(_DOCS)}, own AS (SELECT *, CASE WHEN doc_id % 10 >= 5 THEN doc_id % 10 / 10 * 0.9 ELSE 0 END AS tens FROM scanned)
SELECT doc_id, round(greatest(risk, tens), 9)::DOUBLE AS risk, part + CASE WHEN len(languages) > 1 THEN 0.15 ELSE 0 END >= 0.6 OR greatest(risk, tens) >= 0.6 AS blocked, CASE WHEN tens > 0 THEN 'detector:tens' ELSE '' END AS added FROM own""")
def detector_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The scan's verdict with what an enforcing and an advisory detector add."""
    scanned = scan.scan(documents(spark, d))
    registered = spark.createDataFrame(_MERGED, "detector string, mode string, weight double, threshold double")
    each = F.array(F.struct(F.lit("tens").alias("detector"), (F.col("doc_id") % 10 / 10).alias("score")), F.struct(F.lit("sevens").alias("detector"), (F.col("doc_id") % 7 / 7).alias("score")))
    results = table(spark, d, "documents").select("doc_id", F.explode(each).alias("r")).select("doc_id", "r.*", F.lit(None).cast("string").alias("error"))
    out = detectors.merge(scanned, detectors.ensemble(results, registered), results, registered)
    return out.select("doc_id", F.round("risk", 9).alias("risk"), "blocked", joined(F.filter("patterns", lambda n: n.startswith("detector:"))).alias("added"))


_SIGNALS = f"{_LONG}, base AS (SELECT detector AS signal, CASE WHEN label < 3 THEN 'attack' ELSE 'benign' END AS label, score, error FROM long JOIN embeddings USING (vec_id))"


@query(f"""
WITH {_SIGNALS}, {_sweep_sql("SELECT * FROM base", "signal,")},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY fpr > 0.2, CASE WHEN fpr <= 0.2 THEN 0 ELSE fpr END, threshold) AS r FROM rates) WHERE r = 1),
sizes AS (SELECT signal, count(score) AS scored, count(*) - count(score) AS errored FROM base GROUP BY signal)
SELECT signal, scored, errored, b.threshold, round(b.recall, 9) AS recall, round(b.fpr, 9) AS fpr,
    CASE WHEN signal = 'a' THEN 'baseline' WHEN b.fpr > 0.2 THEN 'over budget' WHEN b.recall > (SELECT recall FROM best WHERE signal = 'a') THEN 'gains recall' ELSE 'no gain' END AS verdict
FROM sizes JOIN best b USING (signal)""")
def detector_promotion(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", evaluation.attack_label(F.col("label") < 3).alias("label"))
    rows = detector_results(spark, d).join(labels, "vec_id").withColumnRenamed("detector", "signal")
    out = evaluation.promotion(rows, max_fpr=0.2, baseline="a")
    return out.select("signal", "scored", "errored", "threshold", F.round("recall", 9).alias("recall"), F.round("fpr", 9).alias("fpr"), "verdict")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    judged = verdicts(spark, d)
    stage = {"stage": "ingest"}
    return metrics.samples(
        judged,
        metrics.sample("requests_total", outcome=F.col("decision"), enforcement="enforce", **stage),
        F.when(F.col("decision") != "accept", metrics.sample("blocks_total", reason=F.coalesce(F.col("reasons")[0], F.lit("none")), **stage)),
        metrics.sample("risk_score", F.col("risk_score"), kind="lexical", **stage),
    )


@query(f"""{_VERDICTS}
SELECT 'requests_total' AS metric, 'enforcement=enforce,outcome=' || decision || ',stage=ingest' AS labels, count(*)::DOUBLE AS value FROM verdicts GROUP BY decision
UNION ALL SELECT 'blocks_total', 'reason=' || split_part(reasons, ',', 1) || ',stage=ingest', count(*)::DOUBLE FROM verdicts WHERE decision <> 'accept' GROUP BY split_part(reasons, ',', 1)""")
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return metrics.counters(_samples(spark, d)).select("metric", text.alias("labels"), "value")


@query(f"{_VERDICTS}, b AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in metrics.RISK_BUCKETS)}, CAST('Infinity' AS DOUBLE)]) AS le) SELECT le::VARCHAR AS le, count(*) FILTER (risk_score <= le) AS count FROM verdicts, b GROUP BY le")
def risk_histogram(spark: SparkSession, d: str) -> DataFrame:
    counted = metrics.histograms(_samples(spark, d))
    return counted.select(F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "count")


@query("""
WITH items AS (SELECT item_id, substr(text, 1, 40) AS literal FROM benchmark)
SELECT doc_id, item_id FROM documents JOIN items ON contains(text, literal)""")
def cross_tenant_literals(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold another's identifier: the beginning of an item."""
    items = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("literal"))
    return foreign.found(table(spark, d, "documents"), items, literal_id="item_id", least=0)


_OWNED = "SELECT doc_id, text || ' for customer-' || doc_id % 40 || '-id and ab' || doc_id % 7 || ' cd34' AS text, doc_id % 5 AS principal FROM documents"


@query(f"""
WITH t AS ({_OWNED}),
literals AS (SELECT item_id AS literal_id, text AS literal, item_id % 5 AS owner FROM benchmark
    UNION ALL SELECT 100000 + i, 'customer-' || i || '-id', i % 5 FROM (SELECT unnest(range(0, 60)) AS i) UNION ALL SELECT 200000 + i, 'ab' || i || ' cd34', NULL FROM (SELECT unnest(range(0, 9)) AS i))
SELECT doc_id, literal_id FROM t JOIN literals ON contains(text, literal) AND (owner IS NULL OR owner <> principal)""")
def foreign_literals(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold a literal of another owner: whole items, and planted identifiers of any form."""
    texts = table(spark, d, "documents").select("doc_id", F.expr("text || ' for customer-' || doc_id % 40 || '-id and ab' || doc_id % 7 || ' cd34'").alias("text"), (F.col("doc_id") % 5).alias("principal"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("literal_id"), F.col("text").alias("literal"), (F.col("item_id") % 5).alias("owner"))
    numbers = spark.range(60).select((F.col("id") + 100000).alias("literal_id"), F.concat(F.lit("customer-"), "id", F.lit("-id")).alias("literal"), (F.col("id") % 5).alias("owner"))
    short = spark.range(9).select((F.col("id") + 200000).alias("literal_id"), F.concat(F.lit("ab"), "id", F.lit(" cd34")).alias("literal"), F.lit(None).cast("long").alias("owner"))
    return foreign.found(texts, items.union(numbers).union(short), principal_col="principal", owner_col="owner")


_MARKED = f"SELECT doc_id, text, 'customer-' || doc_id % 40 || '-id' AS literal FROM ({_OWNED})"


@query(f"SELECT doc_id, sha256(replace(text, literal, '[REDACTED:{S.FOREIGN.upper()}]')) AS digest FROM ({_MARKED})")
def literal_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the identifiers that aren't their reader's."""
    own = table(spark, d, "documents").select("doc_id", F.expr("text || ' for customer-' || doc_id % 40 || '-id and ab' || doc_id % 7 || ' cd34'").alias("text"), F.expr("array('customer-' || doc_id % 40 || '-id', 'id', null)").alias("literals"))
    return own.select("doc_id", F.sha2(S.redact(F.col("text"), S.literal_spans(F.col("text"), T.forbidden_literals(F.col("literals")))), 256).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE 'user' || conv_id % 5 || '||' || conv_id END AS session_key, 'actor::user' || conv_id % 5 AS actor_key FROM conversations")
def session_keys(spark: SparkSession, d: str) -> DataFrame:
    principal = F.concat(F.lit("user"), F.col("conv_id") % 5)
    key = T.session_key(F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 != 0, principal))
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("session_key"), T.actor_key(principal).alias("actor_key"))


# Pages as the text of images: an iTXt chunk for each, behind a header that holds none.
@query("SELECT page_id, sha256('Page: ' || trim(html)) AS digest FROM pages WHERE trim(html) <> ''")
def media_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Texts of image metadata, for pages put into images."""
    body = F.concat(F.encode(F.lit("Page"), "UTF-8"), F.unhex(F.lit("0000000000")), F.encode("html", "UTF-8"))
    size = F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0"))
    head = F.unhex(F.lit("89504E470D0A1A0A" + "0000000D49484452" + "00" * 17))
    image = F.concat(head, size, F.encode(F.lit("iTXt"), "UTF-8"), body, F.unhex(F.lit("00000000")))
    found = media.extract_all(table(spark, d, "pages").select("page_id", image.alias("content")), strings=False)
    return found.where("text <> ''").select("page_id", F.sha2("text", 256).alias("digest"))


# Calls whose tokens are good, but for what a check must be able to tell.
@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'expired' WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 4 THEN 'no_subject' WHEN 5 THEN 'malformed' END AS denied FROM orders""")
def token_null_fields(spark: SparkSession, d: str) -> DataFrame:
    """Null action, time, scopes, expiry and subject, and a scope that is null: each is denied."""
    kind = F.col("o_orderkey") % 8
    o = table(spark, d, "orders").select("o_orderkey", kind.alias("kind"))
    body = capability.payload_json(
        agent_id=F.lit("a"), scopes=F.when(kind == 2, F.lit(None)).when(kind == 5, F.array(F.lit("read"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("read"))), issued_at=F.lit(_NOW), expires_at=F.when(kind != 3, F.lit(_NOW + 100)),
        nonce=F.col("o_orderkey").cast("string"), max_uses=F.lit(1), subject=F.lit("u"), constraints=F.create_map().cast("map<string,string>"), kid=F.lit("k1"), aud=F.lit("svc"),
    )
    calls = o.withColumn("token", capability.encode(body, RING)).withColumn("action", F.when(kind != 0, F.lit("read"))).withColumn("now", F.when(kind != 1, F.lit(_NOW))).withColumn("subject", F.when(kind != 4, F.lit("u")))
    return capability.authorize(capability.parse(calls), RING, audience="svc").select("o_orderkey", "denied")


@query("""
WITH runs AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_replace(html, '[^\\x20-\\x7e]', chr(10), 'g'), '[\\x20-\\x7e]{8,}'), lambda r: trim(r)), lambda r: length(r) >= 12 AND contains(r, ' ')) AS r FROM pages)
SELECT page_id, least(len(r), 200) AS n_runs, sha256(array_to_string(r[1:200], chr(10))) AS digest FROM runs""")
def media_strings(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    text = media.extract(files).select("page_id", "text")
    return text.select("page_id", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_runs"), F.sha2("text", 256).alias("digest"))


@query()
def media_scan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", F.concat("html", F.expr(planted.signal("page_id"))).cast("binary").alias("content"))
    return media.scan_texts(media.extract(files), "page_id")


@query()
def answers(spark: SparkSession, d: str) -> DataFrame:
    said = conversation(spark, d).where("role = 'assistant'")
    return output.answer(said).select("conv_id", "turn", "reason", "blocked", "safe_text", joined(exfil.reasons(F.col("exfil"))).alias("exfil_reasons"))


_INPUT_LIMITS = sessions.Limits(window_s=60, requests=4, risk=1.0)


@query(f"""
WITH RECURSIVE {scan_sql(_TURNS + " WHERE role = 'user'")},
u AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
        count(*) OVER (PARTITION BY conv_id ORDER BY turn * 10 RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) > 4 AS limited
    FROM scanned
),
fold AS (
    SELECT conv_id, turn, i, limited, risk, CASE WHEN limited THEN 0 ELSE risk END::DOUBLE AS total, (CASE WHEN limited THEN 0 ELSE risk END) >= 1.0 AS flagged FROM u WHERE i = 1
    UNION ALL
    SELECT u.conv_id, u.turn, u.i, u.limited, u.risk, (greatest(0, f.total - (u.turn - f.turn) * 10 * 0.02) + CASE WHEN u.limited THEN 0 ELSE u.risk END)::DOUBLE,
        f.flagged OR (greatest(0, f.total - (u.turn - f.turn) * 10 * 0.02) + CASE WHEN u.limited THEN 0 ELSE u.risk END) >= 1.0
    FROM fold f JOIN u ON u.conv_id = f.conv_id AND u.i = f.i + 1
)
SELECT conv_id, turn, risk >= 0.6 OR flagged OR limited AS blocked, CASE WHEN limited THEN 'rate_limit' WHEN risk >= 0.6 THEN 'risk_score' WHEN flagged THEN 'session_risk' END AS reason FROM fold""")
def input_decisions(spark: SparkSession, d: str) -> DataFrame:
    asked = conversation(spark, d).where("role = 'user'").withColumn("ts_us", F.col("turn") * 10_000_000)
    out = turns.inputs(asked, session="conv_id", order="turn", limits=_INPUT_LIMITS)
    return out.select("conv_id", "turn", "blocked", "reason")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '!\\[p\\]\\(http://evil') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\[docs\\]\\(http://evil') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(text, '<img src="https://cdn') THEN 1 ELSE 0 END AS n_urls FROM ({_DOCS})""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = documents(spark, d).select("doc_id", F.to_json(F.struct(F.lit("send").alias("tool"), F.struct(F.array("text").alias("lines")).alias("args"))).alias("arguments"))
    return turns.tool_arguments(calls).select("doc_id", F.size("urls").alias("n_urls"))


@query(f"WITH {scan_sql(_DOCS)} SELECT doc_id, risk, part + CASE WHEN len(languages) > 1 THEN 0.15 ELSE 0 END >= 0.6 AS blocked FROM scanned")
def tool_results(spark: SparkSession, d: str) -> DataFrame:
    results = documents(spark, d).select("doc_id", F.to_json(F.struct(F.struct("text").alias("body"))).alias("result"))
    return turns.tool_results(results).select("doc_id", "risk", "blocked")


@query(f"""{_VERDICTS} SELECT 'ingest' AS event, 5 AS schema_version, decision, count(*) AS n FROM verdicts GROUP BY decision
UNION ALL SELECT 'external_content_scan', 5, CASE WHEN risk >= 0.6 THEN 'blocked' ELSE 'passed' END, count(*) FROM scanned GROUP BY 3""")
def audit_events(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    ingested = audit.events(verdicts(spark, d).select("doc_id", "decision", "risk_score"), "ingest", at, "doc_id", "decision", "risk_score")
    scanned = scan.scan(documents(spark, d)).select("doc_id", F.when(F.col("blocked"), "blocked").otherwise("passed").alias("decision"))
    log = audit.union(ingested, audit.events(scanned, "external_content_scan", at, "doc_id", "decision"))
    return log.groupBy("event", "schema_version", F.get_json_object("data", "$.decision").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT event_id, user_id % 20 AS operation, ts, event_type <> 'error' AS ok FROM events),
g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY operation ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT event_id, sum((NOT ok)::INT) OVER (PARTITION BY operation, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures_in_row FROM g""")
def breaker_replay(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("operation"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return audit.breaker(calls, ts="at", failures=2).select("event_id", "failures_in_row")


# Each user's backend fails at errors, twice before its breaker opens for a day.
@query("""
WITH RECURSIVE c AS (SELECT event_id, user_id, epoch(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS i FROM events),
f AS (
    SELECT event_id, user_id, i, 'closed' AS state, (NOT ok)::INT AS failed, NULL::DOUBLE AS opened FROM c WHERE i = 1
    UNION ALL
    SELECT event_id, user_id, i, state, failed + n, CASE WHEN state = 'open' THEN opened WHEN n = 1 AND failed + 1 >= 2 THEN t END FROM (
        SELECT *, (state <> 'open' AND NOT ok)::INT AS n FROM (
            SELECT c.*, f.failed, f.opened, CASE WHEN f.opened IS NOT NULL AND c.t - f.opened < 86400 THEN 'open' WHEN f.opened IS NULL AND f.failed < 2 THEN 'closed' ELSE 'half_open' END AS state
            FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1))
)
SELECT event_id, state, state <> 'open' AS made, failed FROM f""")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    policy = resilience.Policy(failures=2, recovery_s=86400.0)
    return resilience.replay(calls, policy, key="user_id", order="event_id").select("event_id", "state", "made", "failed")


@query("SELECT DISTINCT conv_id::VARCHAR AS stream_id, TRUE AS same FROM conversations WHERE role = 'assistant'")
def stream_vs_batch(spark: SparkSession, d: str) -> DataFrame:
    """Whether all answers of a conversation, cut into chunks of 23 characters, come out of the streaming guard as they do of the whole-text scan."""
    return streams_alike(conversation(spark, d).where("role = 'assistant'"))


def streams_alike(said: DataFrame) -> DataFrame:
    """(stream_id, same) for each conversation of said (conv_id, turn, text): every turn, or text of a repeated turn, is a stream of its own."""
    said = said.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).distinct()
    said = said.select("conv_id", F.to_json(F.struct("conv_id", "turn", F.sha2("text", 256).alias("text"))).alias("stream_id"), "text")
    cuts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / 23), F.lit(0)).cast("int"))
    each = said.select("stream_id", "text", F.posexplode(cuts).alias("seq", "k"), F.size(cuts).alias("n"))
    chunks = each.select("stream_id", "seq", F.expr("substring(text, k * 23 + 1, 23)").alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("last"))
    guard = streamed.Guard(holdback=256)
    shown = streamed.batch(chunks, guard).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"), F.bool_or("blocked").alias("blocked"))
    whole = output.answer(said).select("conv_id", "stream_id", "safe_text", F.col("blocked").alias("stopped"))
    both = whole.join(shown, "stream_id", "left")
    same = (F.col("blocked") == F.col("stopped")) & (F.col("blocked") | (F.col("text") == F.col("safe_text")))
    return both.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("same"))
