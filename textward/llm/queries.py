"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import decontaminate, embeddings, language, licenses, mixing, neardup, ngrams, quality, tokens, warc

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(buckets: int, bucket: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets == bucket, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = quality.train(docs, labels.where(~held_out(4, 2)))
    out = quality.scored(docs.select("doc_id", "text"), ranker)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out(3, 1)))
    return language.detect(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ngrams.scored(docs, ngrams.train(docs.where(~held_out(5, 1))))
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_embeddings": op2_embeddings,
    "op3_quality": op3_quality,
    "op4_tokens": op4_tokens,
    "op5_language": op5_language,
    "op6_licenses": op6_licenses,
    "op7_language_model": op7_language_model,
    "op8_warc": op8_warc,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
}

_COMPONENTS = """
    edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(node, least) AS (
        SELECT id, id FROM nodes
        UNION
        SELECT e.y, r.least FROM reach r JOIN edges e ON e.x = r.node
    ),
    groups AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
"""

SQL = {
    "op2_embeddings": f"""
WITH RECURSIVE
    vectors AS (
        SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    ),
    usable AS (
        SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors
        WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND list_dot_product(v, v) > 0
    ),
    links AS (
        SELECT a.id AS x, b.id AS y FROM usable a JOIN usable b ON a.id < b.id AND len(a.v) = len(b.v)
        WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
    ),
    nodes AS (SELECT id FROM vectors),
    {_COMPONENTS}
SELECT g.node AS vec_id, (SELECT count(*) FROM edges e WHERE e.x = g.node) AS n_links,
       g.component_id, g.node = g.component_id AS kept
FROM groups g
""",
    "op8_warc": """
WITH payloads AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
),
digests AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS holder,
        list_aggregate(list_transform(range(0, 8), lambda g:
            list_aggregate(list_transform([15, 10, 5, 0], lambda s:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (g * 5 + 1)::INT, 5))::INT >> s::INT) & 31) + 1, 1)),
            'string_agg', '')), 'string_agg', '') AS payload_digest
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM digests
""",
    "op9_minhash": f"""
WITH RECURSIVE
    texts AS (
        SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    sets AS (
        SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
        FROM texts
    ),
    shingles AS (SELECT id, unnest(s) AS g FROM sets),
    shared AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
    links AS (
        SELECT x, y FROM shared JOIN sets a ON a.id = x JOIN sets b ON b.id = y
        WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)
    ),
    nodes AS (SELECT id FROM sets),
    {_COMPONENTS}
SELECT g.node AS doc_id, len(s.s)::BIGINT AS n_shingles, g.component_id, g.node = g.component_id AS kept
FROM groups g JOIN sets s ON s.id = g.node
""",
}
