"""Cleaning a training corpus: low quality out, near copies out, test items out, sources mixed, texts encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm import decontaminate, mixing, neardup, quality, tokens
from textward.llm.queries import VOCABULARY, held_out, table
from textward.llm.scratch import Scratch, free

#: Near copies share so many per cent of their 5-word shingles; op9_minhash has its own threshold.
NEAR_PERCENT = 80
#: Shorter benchmark items are sequences that clean texts have too: op1_decontamination reports them, no document is dropped for them.
ITEM_WORDS = 6


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored quality.ACCEPT or more, learned from the labelled ones among them that aren't held out.

    Null and empty texts are scored as empty ones; repeated rows stay or go alike; rows without an id are
    scored but not learned from. Without labels all stay. An empty table stays empty; columns may have any names.
    """
    score = free(docs.columns, "score")
    ranker = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return quality.scored(docs, ranker, score_col=score).where(F.col(score) >= quality.ACCEPT).select(*own(docs))


def own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group of near copies; rows without an id or words all stay.

    Rows of one id are told apart by their texts. Of rows with equal id and text the least one stays.
    An empty table stays empty; columns may have any names.
    """
    key = free(docs.columns, "key")
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = neardup.near_duplicates(keyed, id_col=key, percent=NEAR_PERCENT).where("n_shingles > 0").select(F.col(key).alias("k"), "component_id").where("k is not null").distinct()
    ids = keyed.groupBy(F.col(key).alias("k")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = Scratch(spark, "near-copies").keep(found.join(ids, "k"), "groups")
    firsts = groups.groupBy("component_id").agg(F.min(F.struct("id", "k")).alias("first")).select("first.k")
    again = groups.where("n > 1").join(firsts, "k", "left_semi").select(F.col("k").alias(key))
    others = groups.join(firsts, "k", "left_anti").select(F.col("k").alias(key))
    if again.isEmpty():
        return keyed.join(others, key, "left_anti").select(*own(docs))
    one = keyed.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*own(docs))).alias("row")).select("row.*")
    return keyed.join(others.union(again), key, "left_anti").select(*own(docs)).union(one)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item of ITEM_WORDS words or more is found.

    Null and empty texts hold none and stay; repeated rows stay or go alike. An empty table stays empty, and
    without items all rows stay; columns may have any names.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_item_words=ITEM_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0, 1 or 2 times) as the mix takes them, in its order from file to file.

    Rows without words go, a null source is one of the sources, repeated rows are mixed each for itself.
    An empty table stays empty; columns may have any names.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the order of the mix and read back: doc_id, start, n_tokens, ids_crc32.

    The order is that of docs' files and of the rows in them; where docs isn't read from files, it is ascending
    doc_id. A null or empty text has the end id alone, rows without an id have a null one, repeated rows are each
    written. An empty table gives no rows; columns of other names aren't read.
    """
    return tokens.round_trip(docs, public_tokenizers.path(VOCABULARY), order=_order(docs))


def _order(docs: DataFrame) -> list | None:
    place = [F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        return docs.select(*place) and place
    except AnalysisException:  # no files, so rows have no places
        return None


STAGES = [
    ("quality classifier", filter_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", encode_tokens),
]

#: Not expressible: fitted weights, alignment and tokenizer have no SQL. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
