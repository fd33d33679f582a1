"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import data  # noqa: E402

import corpus_pipeline  # noqa: E402
from cohortspan.llm import queries as Q  # noqa: E402
from cohortspan.llm import mixing, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        if name != "bpe_encoding":
            assert docs.columns == COLUMNS
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "bpe_encoding"]

    before, after = seen["toxicity"]
    scored = toxicity.toxicity(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in scored.collect() if not r.predicted} == {i for i, _ in rows_of(after)}

    before, after = seen["ngram_jaccard_join"]
    classes = brute.near_duplicates(rows_of(before))
    assert {i for i, _ in rows_of(after)} == {v[0] for v in classes.values()}
    assert after.count() < before.count()

    before, after = seen["suffix_array_dedup"]
    gone = {w[0]: w[2] for w in brute.kept_bytes(rows_of(before), corpus_pipeline.PASSAGE_BYTES)}
    raw = dict(rows_of(before))
    for row in after.collect():
        left = len(raw[row.doc_id].encode()) - gone[row.doc_id]
        assert left - 6 * 4 <= len(row.text.encode()) <= left
        assert row.n_chars == len(row.text)
    assert sum(gone.values()) > 0

    before, after = seen["source_mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_report(before).collect()}
    assert after.count() == sum(copies.values())

    before, after = seen["bpe_encoding"]
    library = brute.tokenizer(Q.tokenizer_path(Q.WORD_BPE))
    texts = dict(rows_of(before))
    for row in after.collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids and row.n_tokens == len(ids)
        assert row.text == library.decode(ids, skip_special_tokens=False)


def test_stages_take_awkward_documents(spark, tmp_path):
    docs = data.documents(spark, data.awkward(), extra=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = data.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
