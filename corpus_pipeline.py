"""A corpus pipeline: toxicity, near duplicates, repeated passages, source mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from cohortspan.llm.queries import TOKEN_ROWS, WORD_BPE, settle, tokenizer_path
from cohortspan.session import scratch


# Bytes of a passage that must not occur twice. Of the passages of 50 words and more that documents of the 0.1 table
# share (346 bytes in the median, one in twenty below 289), windows of 280 bytes reach 95 of 100; windows of 400 reach 56.
PASSAGE_BYTES = 280


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts stay, equal texts share their fate, ids play no part."""
    settle(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, of repeated rows one; documents without words all stay, and so
    do those without an id."""
    settle(spark)
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again are cut out of the texts, wherever they stand; every document stays, if need be with an
    empty text. Rows that repeat repeat each other's passages; ids play no part."""
    settle(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, which may be never or up to three times. A null source is a
    source; documents without words are taken never."""
    settle(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit integers) and the text they decode to; none for a null text."""
    settle(spark, TOKEN_ROWS)
    decoded = bpe.round_trip(docs, tokenizer_path(WORD_BPE))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "text")


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("bpe_encoding", tokens),
]

# No SQL for a trained classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
