"""The corpus queries and the SQL some of them are checked with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm import bpe, debruijn, filter_audit, html_text, imatch, licenses, mixing, ngram_join, suffix_dedup, token_files, topk, toxicity, whitening
from cohortspan.session import scratch

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2


# Rows that go to a Python worker at a time. Texts are long; Spark's 10,000 would be tens of megabytes per task, held
# by the executor and the worker, on the way there and back.
BATCH_ROWS = 1_000


# Rows at a time where a worker also holds a vocabulary and its memory of pieces, and sends more back than it gets.
TOKEN_ROWS = 200


def settle(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents"))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(read(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = debruijn.kept_words(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    settle(spark, TOKEN_ROWS)
    decoded = bpe.round_trip(docs, tokenizer_path(WORD_BPE))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch(spark, "token-files")
    files = token_files.write_tokens(read(spark, folder, "documents"), tokenizer_path(BYTE_BPE), place, END_ID)
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_report(read(spark, folder, "documents"))


def op7_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(read(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licences(read(spark, folder, "documents"))


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(read(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def queries() -> dict[str, Query]:
    named = (
        op1_ngram_jaccard_join,
        op2_source_mixing,
        op3_substring_dedup,
        op4_bpe_encoding,
        op5_token_files,
        op6_suffix_dedup,
        op7_document_fingerprints,
        op8_license_scan,
        op9_exact_topk,
        op10_toxicity,
        op11_filter_interaction_audit,
        op12_html_extraction,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixing.SQL, "op9_exact_topk": topk.SQL, "op11_filter_interaction_audit": filter_audit.SQL}
