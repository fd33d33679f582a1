"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import collections
import importlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import data  # noqa: E402

from cohortspan.llm import bpe, debruijn, imatch, licenses, mixing, ngram_join, suffix_dedup, token_files, toxicity  # noqa: E402
from cohortspan.llm import queries as Q  # noqa: E402

LABELS = "doc_id bigint, quality int, toxic int"


def labels(spark):
    rows = [(k, 1, k % 2) for k in range(1, 10)] + [(6, 0, 1), (6, 0, None), (None, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def tokens(df, spark, tmp_path):
    files = token_files.write_tokens(df, Q.tokenizer_path(Q.BYTE_BPE), str(tmp_path / "files"), 2)
    return token_files.read_tokens(files)


OPERATORS = {
    "ngram_join": lambda df, spark, tmp: ngram_join.near_duplicates(df),
    "mixing": lambda df, spark, tmp: mixing.mix_report(df),
    "debruijn": lambda df, spark, tmp: debruijn.kept_words(df),
    "bpe": lambda df, spark, tmp: bpe.decode(bpe.encode(df, Q.tokenizer_path(Q.WORD_BPE)), Q.tokenizer_path(Q.WORD_BPE)),
    "token_files": tokens,
    "suffix_dedup": lambda df, spark, tmp: suffix_dedup.removal_report(df),
    "imatch": lambda df, spark, tmp: imatch.fingerprints(df),
    "licenses": lambda df, spark, tmp: licenses.licences(df),
    "toxicity": lambda df, spark, tmp: toxicity.toxicity(df, labels(spark)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_come_through_once_each(spark, tmp_path, name):
    rows = data.awkward()
    found = OPERATORS[name](data.documents(spark, rows, extra=True), spark, tmp_path).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](data.documents(spark, []), spark, tmp_path).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_table_of_nulls(spark, tmp_path, name):
    df = data.documents(spark, [(None, None), (None, None), (4, None)]).withColumn("source", F.lit(None).cast("string"))
    assert len(OPERATORS[name](df, spark, tmp_path).collect()) == 3


def test_awkward_texts_match_brute_force(spark):
    rows = [r for r in data.awkward() if r[0] != 4 and r[0] != 5] + [(30, "q " * 700), (31, "q " * 700), (31, "q " * 700)]
    df = data.documents(spark, rows)
    assert collections.Counter(map(tuple, suffix_dedup.removal_report(df).collect())) == collections.Counter(brute.kept_bytes(rows))
    kept = debruijn.kept_words(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(brute.kept_words(rows))


def test_copies_and_wordless_documents(spark):
    found = collections.defaultdict(list)
    for r in ngram_join.near_duplicates(data.documents(spark, data.awkward())).collect():
        found[r.doc_id].append((r.class_id, r.n_links))
    assert found[2] == [(2, 0)] and found[3] == [(3, 0)] and found[1] == [(1, 0)]
    assert found[4] == [(4, 2)] and found[5] == [(4, 2), (4, 2)]
    assert found[6] == [(6, 2)] and found[7] == [(6, 2)]
    assert sorted(found[None], key=str) == [(6, 2), (None, 0)]


def test_scores_without_labels_are_zero(spark):
    df = data.documents(spark, data.awkward())
    for known in ([], [(1, 0, 1)], [(6, 0, 0)]):
        found = toxicity.toxicity(df, spark.createDataFrame(known, LABELS)).collect()
        assert {(r.score, r.predicted) for r in found} == {(0.0, 0)}


def test_source_names(spark):
    rows = [(k, "w " * (k + 1), "en", s, 1) for k, s in enumerate(["", None, "é", "z", "", None, "ￇ", "𝒂"])]
    found = mixing.mix_report(spark.createDataFrame(rows, data.DOCUMENTS)).collect()
    weights = {"": 5, "z": 2, "é": 1, "ￇ": 5, "𝒂": 2, None: 1}
    sizes = collections.Counter()
    for k, row in enumerate(rows):
        sizes[row[3]] += k + 1
    capped = {r.source for r in found if r.target == 3 * r.source_size}
    level = {r.target / weights[r.source] for r in found if r.source not in capped}
    assert max(level) - min(level) < 1e-9
    assert all(min(level) * weights[s] >= 3 * sizes[s] - 1e-9 for s in capped)


def test_sources_without_words(spark):
    rows = [(1, None, "en", "a", 0), (2, " ", "en", "b", 0)]
    found = mixing.mix_report(spark.createDataFrame(rows, data.DOCUMENTS)).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_operators_do_not_hide_import_errors():
    for name in ("corpus_pipeline", "cohortspan.llm.queries"):
        assert "except" not in Path(importlib.import_module(name).__file__).read_text()
