"""The corpus operators against plain versions of themselves."""

from __future__ import annotations

import collections
import gc
import hashlib
import math
import random
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import data  # noqa: E402

from cohortspan.llm import bpe, debruijn, imatch, licenses, mixing, ngram_join, suffix_dedup, token_files, topk, toxicity  # noqa: E402
from cohortspan.llm import queries as Q  # noqa: E402
from cohortspan.llm.common import Steps, numbered  # noqa: E402
from cohortspan.llm.components import connected_components  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def texts(spark, folder=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def as_set(rows):
    return collections.Counter(map(tuple, rows))


def test_near_duplicates_match_brute_force(spark):
    for rows in (data.passages(), texts(spark)):
        found = ngram_join.near_duplicates(data.documents(spark, rows)).collect()
        wanted = brute.near_duplicates(rows)
        assert {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in found} == wanted
        assert max(v[1] for v in wanted.values()) > 0


def test_large_group_is_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    rng = random.Random(4)
    base = data.sentence(rng, 120).split(" ")
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = data.sentence(rng, 1)
        rows.append((k, " ".join(own)))
    found = ngram_join.near_duplicates(data.documents(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in found} == brute.near_duplicates(rows)


def test_bands_reach_the_recall_wanted():
    bands = ngram_join.bands_for(0.8, 6, 1e-5)
    assert (1 - 0.8**6) ** bands <= 1e-5 < (1 - 0.8**6) ** (bands - 1)


def test_connected_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), Steps(spark, "test")).collect()
    assert {r.node: r.label for r in found} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert len(found) == 41 + 60


def test_numbered_counts_every_row_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = numbered(df, ["v"], Steps(spark, "test"), "place").collect()
    assert all(r.v == r.place for r in rows) and len(rows) == 1000


@pytest.mark.parametrize("weights,limit", [((5, 2, 1), 3), ((1,), 2), ((100, 1), 3)])
def test_mix_comes_near_its_targets(spark, weights, limit):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_report(docs, weights, limit).toPandas()
    total = rows["size"].sum()
    goals = rows.groupby("source")["target"].first()
    assert abs(goals.sum() - total) < 1e-6 * total
    for source, group in rows.groupby("source"):
        assert abs(group["taken"].sum() - group["target"].iloc[0]) <= 2 * group["size"].max() + 1
        assert group["target"].iloc[0] <= limit * group["size"].sum() + 1e-6
    assert (rows["taken"] <= limit * rows["size"]).all()
    again = mixing.mix_report(docs.repartition(7), weights, limit).toPandas()
    assert as_set(rows[["doc_id", "taken"]].itertuples(index=False)) == as_set(again[["doc_id", "taken"]].itertuples(index=False))


def test_mixed_documents_are_those_of_the_report(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect() if r.copies}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_substring_removal_matches_brute_force(spark):
    for rows in (data.passages(), data.passages(9, 80), texts(spark)):
        found = debruijn.kept_words(data.documents(spark, rows)).select(
            "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)
        )
        wanted = brute.kept_words(rows)
        assert as_set(found.collect()) == as_set(wanted)
        assert sum(w[2] for w in wanted) > 0


def test_substring_removal_reaches_every_place_of_a_path(spark):
    rng = random.Random(11)
    for n in (55, 70, 130):
        passage = data.sentence(rng, n)
        many = " ".join(data.sentence(rng, 7) + " " + passage for _ in range(13))
        loop = " ".join([passage] * 9)
        rows = [(2, data.sentence(rng, 5) + " " + passage + " " + data.sentence(rng, 5)), (9, many), (9, "x " + many), (12, loop), (15, many)]
        found = debruijn.kept_words(data.documents(spark, rows)).select(
            "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)
        )
        wanted = brute.kept_words(rows)
        assert as_set(found.collect()) == as_set(wanted)
        assert wanted[1][2] >= 13 * n


def test_compaction_makes_long_paths(spark):
    rng = random.Random(3)
    passage = data.sentence(rng, 400)
    rows = [(k, data.sentence(rng, 30) + " " + passage + " " + data.sentence(rng, 30)) for k in range(6)]
    keyed = data.documents(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h"))
    steps = Steps(spark, "test")
    cells = debruijn.paths(keyed, 50, 24, False)
    shared = cells.groupBy("core").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    table = steps.table(cells.join(shared.select("core"), "core", "left_semi"), "cells")
    runs = debruijn.compacted(table, steps)
    longest = runs.agg(F.max(F.col("last") - F.col("first"))).first()[0]
    assert longest > 200 > table.agg(F.max(F.col("last") - F.col("first"))).first()[0]


def test_suffix_removal_matches_brute_force(spark):
    for rows in (data.passages(), data.passages(5, 64)):
        found = suffix_dedup.removal_report(data.documents(spark, rows)).collect()
        wanted = brute.kept_bytes(rows)
        assert as_set(found) == as_set(wanted)
        assert sum(w[2] for w in wanted) > 0
    found = suffix_dedup.removal_report(data.documents(spark, data.passages()), 60).collect()
    assert as_set(found) == as_set(brute.kept_bytes(data.passages(), 60))


def test_suffix_removal_lists_the_cells_of_repeated_rows_once(spark, monkeypatch):
    rng = random.Random(8)
    text, other = data.sentence(rng, 300), data.sentence(rng, 300)
    rows = [(7, text)] * 20 + [(None, other)] * 20 + [(8, data.sentence(rng, 9) + text)]
    lists = []
    merged = suffix_dedup.merged_spans
    monkeypatch.setattr(suffix_dedup, "merged_spans", lambda df, window: lists.append(df) or merged(df, window))
    found = suffix_dedup.removal_report(data.documents(spark, rows)).collect()
    assert as_set(found) == as_set(brute.kept_bytes(rows))
    for row in lists[0].collect():
        assert len(row.starts) <= 2 * len(set(row.starts)), (row.doc_id, len(row.starts), len(set(row.starts)))


def test_suffix_removal_with_lists_too_long_for_broadcast(spark, monkeypatch):
    from cohortspan.llm import windows

    monkeypatch.setattr(windows, "BROADCAST_BYTES", -1)
    found = suffix_dedup.removal_report(data.documents(spark, data.passages())).collect()
    assert as_set(found) == as_set(brute.kept_bytes(data.passages()))


def test_bpe_is_what_the_library_makes(spark):
    path = Q.tokenizer_path(Q.WORD_BPE)
    library = brute.tokenizer(path)
    rows = texts(spark) + [(1000 + k, t) for k, (_, t) in enumerate(data.awkward())]
    rng = random.Random(2)
    alphabet = "aAzZéÉßΣσςİı '’´`́  　\u0085\x1c\x1d\t\n09½²漢字한글ไทย😀_-!?<|>endoftext"
    rows += [(2000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(3000, "a<|endoftext|>b <|startoftext|><|endoftext|> c"), (3001, "!" * 3000), (3002, "we're I'LL they'd 'S")]
    docs = data.documents(spark, rows)
    found = bpe.decode(bpe.encode(docs, path), path).collect()
    assert as_set(bpe.round_trip(docs, path).collect()) == as_set(found)
    wanted = {}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted[doc_id] = (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))
    assert {r.doc_id: (bytes(r.ids), r.text) for r in found} == wanted


def test_queue_skips_stale_entries():
    spec = {
        "model": {
            "type": "BPE",
            "end_of_word_suffix": "</w>",
            "vocab": {"a": 0, "b": 1, "c</w>": 2, "ab": 3, "bc</w>": 4, "abc</w>": 5, "b</w>": 6},
            "merges": [["b", "c</w>"], ["a", "b"], ["a", "bc</w>"]],
        },
        "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"\S+"}}]},
        "added_tokens": [{"content": "<e>", "id": 9}],
    }
    import json

    vocabulary = bpe.Vocabulary(json.dumps(spec).encode())
    assert vocabulary.word("abc") == [5]
    assert vocabulary.word("abab") == [3, 0, 6]


@pytest.mark.parametrize("size", [0, 1, 5, 1023, 1024, 1025, 40_000])
def test_blocks_round_trip(size):
    rng = np.random.RandomState(size)
    for ids in (
        rng.randint(0, 50_000, size),
        np.where(rng.rand(size) < 0.05, 2**32 - 1, rng.randint(0, 40, size)),
        np.full(size, 7),
        rng.randint(0, 2**32, size, dtype=np.uint64),
    ):
        ids = ids.astype(np.uint32)
        payload, start = token_files.pack(ids)
        assert (token_files.unpack(np.frombuffer(payload, np.uint8), start, size) == ids).all()
        raw = token_files.file_bytes(ids, np.array([size]), np.array([3]), np.array([True]))
        opened = token_files.TokenFile(raw)
        for low, high in ((0, size), (size // 3, 2 * size // 3), (size // 2, size)):
            assert (opened.ids(low, high) == ids[low:high]).all()


def test_small_widths_are_used():
    ids = np.arange(100_000, dtype=np.uint32) % 16
    ids[::100] = 50_000
    payload, _ = token_files.pack(ids)
    assert len(payload) < 100_000 * 0.7


def test_token_files_are_what_the_library_makes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 5_000)
    path = Q.tokenizer_path(Q.BYTE_BPE)
    library = brute.tokenizer(path)
    rng = random.Random(6)
    alphabet = "aA é́  \u0085\x1c\t\n\r09½漢😀'_-!?<|>  "
    rows = texts(spark) + [(2000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(3000, "a<|endoftext|>b"), (3001, None), (3002, ""), (3003, "we're 'twas  it 's")]
    files = token_files.write_tokens(data.documents(spark, rows).repartition(5), path, str(tmp_path / "t"), 2)
    assert files.count() > 5
    found = token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    wanted, start = {}, 0
    for doc_id, text in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.crc) for r in found} == wanted


def test_fingerprints(spark):
    rows = sorted(texts(spark))
    found = {r.doc_id: r for r in imatch.fingerprints(data.documents(spark, rows)).collect()}
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[doc_id].n_chars == len(text)
        assert found[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[doc_id].near_next <= 1
    by_text = collections.defaultdict(set)
    for doc_id, text in rows:
        by_text[text].add(found[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({r.fingerprint for r in found.values()}) > 0.9 * len(by_text)
    mean = lambda name: sum(r[name] for r in found.values()) / len(found)
    assert mean("near_edited") > mean("near_next") + 0.05


def test_fingerprints_follow_the_lexicon(spark):
    """The sets behind a fingerprint, counted in plain Python."""
    import re

    import xxhash

    rows = sorted(texts(spark))
    parts = [set(re.split(r"[\W_]+", t.lower())) - {""} for _, t in rows]
    count = collections.Counter(w for p in parts for w in p)
    kept = {w for w, n in count.items() if imatch.LOW * len(rows) <= n <= max(imatch.HIGH * len(rows), 1)}
    lexicon = imatch.lexicon(data.documents(spark, rows).select("doc_id", "text"), Steps(spark, "test")).collect()
    assert {r.term for r in lexicon} == kept
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    assert all(r.hash == signed(xxhash.xxh64(r.term.encode(), seed=42).intdigest()) & ((1 << 40) - 1) for r in lexicon)
    hashes = {r.term: r.hash for r in lexicon}
    found = {r.doc_id: r.fingerprint for r in imatch.fingerprints(data.documents(spark, rows)).collect()}
    for (doc_id, _), p in zip(rows, parts):
        total = sum(hashes[w] for w in p & kept)
        if p & kept:
            code = xxhash.xxh64(total.to_bytes(8, "little"), seed=42).intdigest() & 0xFFFF
            assert found[doc_id][:4] == f"{code:04x}"


def test_no_python_in_fingerprint_plans(spark, capsys):
    docs = data.documents(spark, data.passages())
    steps = Steps(spark, "test")
    keyed = imatch.keyed_texts(docs)
    words = imatch.lexicon(keyed, steps)
    imatch.set_hashes(imatch.with_edited(keyed, imatch.following(keyed, steps)), words).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_licence_notices_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in licenses.licences(docs).collect()}
    marks = {
        "apache": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "mit": "Released under the MIT License.",
    }
    right = wrong = missed = 0
    for row in docs.collect():
        wanted = {k for k, mark in marks.items() if mark in row.text.split("\n")}
        got = set(found[row.doc_id].families.split(",")) - {""}
        right += len(wanted & got)
        missed += len(wanted - got)
        wrong += len(got - wanted)
    assert right > 20 and missed == 0 and wrong <= 0.02 * right


def test_top_k_reads_vectors_until_certain():
    rng = np.random.RandomState(1)
    exact = rng.randint(-40, 40, (3000, 16))
    query = rng.randint(-40, 40, 16)
    width, low = 5, -40
    edges = low + width * np.arange(topk.CELLS + 1, dtype=float)
    lower, upper = topk.bounds(((exact - low) // width).astype(np.uint8), edges, query[None, :].astype(float))
    scores = exact @ query
    assert (lower[0] <= scores).all() and (scores <= upper[0]).all()
    places, found = topk.best(query, exact, upper[0], np.arange(3000), 20)
    assert list(found) == sorted(scores, reverse=True)[:20]
    assert list(places) == sorted(range(3000), key=lambda i: (-scores[i], i))[:20]


def test_top_k_with_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * k, [float(k), 1.0]) for k in range(4)] + [
        (20, [1.0, 1.0]),
        (21, None),
        (22, []),
        (23, [nan, 1.0]),
        (24, [None, 1.0]),
        (25, [inf, 1.0]),
        (40, [1.0, 2.0, 3.0]),
        (None, [9.0, 9.0]),
        (3, [0.5, 0.5]),
        (2, [0.5, 0.5]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk.search(df, F.col("vec_id") % 20 == 0, 3).collect()
    usable = [(i, v) for k, (i, v) in enumerate(rows) if v and all(x is not None and abs(x) < 1e300 for x in v)]
    wanted = []
    for k, (i, v) in enumerate(usable):
        if i is not None and i % 20 == 0:
            scored = [
                (-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), float("inf") if j is None else j)
                for m, (j, w) in enumerate(usable)
                if m != k and len(w) == len(v)
            ]
            wanted += [(i, n, None if j == inf else j, -s) for n, (s, j) in enumerate(sorted(scored)[:3], start=1)]
    assert as_set(found) == as_set(wanted)
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def exact_top(rows, k):
    """Query, rank, id and score by Python's integers, for rows with distinct ids."""
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    found = []
    for i, v in vectors:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i and len(w) == len(v))
            found += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], start=1)]
    return found


def test_top_k_with_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(6)
    rows = []
    for i in range(120):
        size = (0.5, 3e6, 2e7)[i % 3]  # two of three vectors are wide
        rows.append((i, [rng.uniform(-size, size) for _ in range(3)]))
    rows += [(120, [2_000_000.0, 1.0, 0.0]), (140, [2_000_000.0, 1.0, 0.0])]
    apart = [*rows[-2:], (141, [0.0, 0.0, 2.0**55]), (3, [1.0, 0.5, 2.0])]
    for given in (rows, apart):
        df = spark.createDataFrame(given, "vec_id bigint, embedding array<double>")
        assert as_set(topk.search(df, F.col("vec_id") % 20 == 0, 7).collect()) == as_set(exact_top(given, 7))


def test_top_k_beyond_64_bits_is_an_error(spark):
    for rows in ([(20, [2.0**40]), (1, [2.0**40])], [(20, [1e300]), (1, [0.5])]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="does not fit into 64 bits"):
            topk.search(df, F.col("vec_id") % 20 == 0).collect()


def test_top_k_with_columns_of_clashing_names(spark):
    rows = [(20 * k, [float(k), 1.0]) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    clash = df.select("*", *(F.lit(f"own {c}").alias(c) for c in [*data.CLASHING, "query", "dim", "wide", "c", "q", "packed", "blocks"]))
    asked = F.col("vec_id") % 20 == 0
    assert as_set(topk.search(clash, asked, 3).collect()) == as_set(topk.search(df, asked, 3).collect())


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in found.itertuples())
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.94
    assert held[held.toxic == 0].predicted.mean() < 0.01
    assert held[held.toxic == 1].score.mean() > 5 * held[held.toxic == 0].score.mean()
    assert ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_toxicity_does_not_move_with_the_size_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    few, all_of_them = (
        toxicity.toxicity(known, labels, rows).join(labels, "doc_id").orderBy("doc_id").toPandas() for rows in (350, 100_000)
    )
    assert (few.predicted != all_of_them.predicted).mean() < 0.03
    assert (few.score - all_of_them.score).abs().mean() < 0.06
    assert few[few.held_out & (few.toxic == 0)].predicted.mean() < 0.03


def test_common_lengths_of_all_pairs():
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    found = suffix_dedup.common_lengths(rows, 6)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j:
                same = 0
                while same < min(6, len(a), len(b)) and a[same] == b[same]:
                    same += 1
                assert found[i, j] == same


@pytest.mark.parametrize("window", [200, 280, 350])
def test_suffix_removal_by_other_windows(spark, window):
    rows = data.passages(12, 56)
    found = suffix_dedup.removal_report(data.documents(spark, rows), window).collect()
    assert as_set(found) == as_set(brute.kept_bytes(rows, window))


@pytest.mark.parametrize("group", [1, 3])
def test_suffix_removal_with_cores_of_many_entries(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = data.passages(11, 56)
    found = suffix_dedup.removal_report(data.documents(spark, rows)).collect()
    assert as_set(found) == as_set(brute.kept_bytes(rows))


def test_new_pieces_of_many_texts_share_a_call(monkeypatch):
    """A sign after a word is no other word, and the library is not called for each text."""
    pieces = token_files.Pieces(Path(Q.tokenizer_path(Q.BYTE_BPE)).read_bytes())
    texts = [f"word{'abc'[k % 3]}, it's {k}½ don't[x]\\Ñé_ \n  end.{chr(200 + k)}" for k in range(300)] + ["", None, "a<|endoftext|>,b"]
    expected = pieces.encode([t or "" for t in texts])
    calls, encode = [], pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda some: calls.append(len(some)) or encode(some))
    assert list(pieces.texts(texts)) == expected and len(calls) <= 3
    assert " it" in pieces and " end" in pieces and "worda" in pieces and "worda," not in pieces


def test_token_workers_send_back_small_parts():
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["some words"] * 1000)], names=["doc_id", "text"])
    parts = list(bpe.encoded(iter([batch]), bpe.loaded(Path(Q.tokenizer_path(Q.WORD_BPE)).read_bytes())))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 100


def test_new_words_of_many_texts_are_merged_together(monkeypatch):
    """Only words of many letters go through the queue, and all get the ids they get there."""
    memory = bpe.Remembered(bpe.Vocabulary(Path(Q.tokenizer_path(Q.WORD_BPE)).read_bytes()))
    texts = [f"Word{'abc'[k % 3]}, it's {k}½ don't[x] ΑΣ\x1cÑé_\xa0thein{'the' * (k % 20)}\n" for k in range(300)]
    texts += ["", None, "́a á", "b" * 300, "a<|endoftext|>,b　c"]
    by_queue = bpe.Remembered(memory.vocabulary)
    expected = [bpe.encode_text(t, by_queue) if t else b"" for t in texts]
    queue, one = [], memory.vocabulary.word
    monkeypatch.setattr(memory.vocabulary, "word", lambda word: queue.append(word) or one(word))
    assert memory.texts(texts) == expected
    assert {w for w in queue if len(w) < 60} <= set("abc,") | {"b"}
    memory.clear()
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    assert [x for k in range(0, len(texts), 10) for x in memory.texts(texts[k : k + 10])] == expected


def test_pieces_are_cut_without_an_object_for_each(monkeypatch):
    """The pattern cuts only texts with white space of more than one byte; others come apart at the same places or fewer."""
    pieces = token_files.Pieces(Path(Q.tokenizer_path(Q.BYTE_BPE)).read_bytes())
    texts = [" \n\n a  b,c\t\r\n é, ü;×,÷,\x1c\n x \n", "\n", " ", "", "end \n", "\n next", "a" + " " * 5, "don't 'tis \n\nno"] * 3
    expected = pieces.encode(texts)
    monkeypatch.setattr(token_files, "_PIECES", None)
    assert list(pieces.texts(texts)) == expected and "é" not in pieces and " é" in pieces
    monkeypatch.undo()
    wide = ["a \xa0b\n 　 c", "\x85x \x85 y"]
    assert list(pieces.texts(wide)) == pieces.encode(wide)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    assert [x for t in texts for x in pieces.texts([t])] == expected


def test_near_duplicates_move_no_texts_where_few_documents_go(spark):
    """Planned by the ids that go, not by the table of all classes, which is larger than may be broadcast."""
    rows = [(k, f"w{k % 1999} " * 3 + "a b c d e f g h", "en", "s", 1) for k in range(2003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
        one = ngram_join.one_of_each(docs)
        plan = one._jdf.queryExecution().sparkPlan().toString()
        assert one.count() == 1999
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_token_workers_stay_small():
    """A vocabulary is arrays and strings, and a batch of long texts is not cut all at once."""
    source = Path(Q.tokenizer_path(Q.WORD_BPE)).read_bytes()
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randint(0, 300)}, it's" for _ in range(2500)) for _ in range(100)] + [None, "", "end"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    expected = bpe.Remembered(bpe.Vocabulary(source)).texts(texts)
    gc.collect()
    tracemalloc.start()
    memory = bpe.Remembered(bpe.Vocabulary(source))
    gc.collect()
    assert tracemalloc.get_traced_memory()[0] < 12e6
    tracemalloc.reset_peak()
    found = [ids for part in bpe.encoded(iter([batch]), memory) for ids in part.column("ids").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == expected and peak < 40e6


def test_batches_are_parted_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BYTES", 10)
    texts = ["", "abc", None, "é" * 3, "a" * 40, "", None, "b", "c" * 10, "d"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for whole in (batch, batch.slice(3)):
        parts = list(bpe.parted(whole))
        assert [x for p in parts for x in p.column("doc_id").to_pylist()] == whole.column("doc_id").to_pylist()
        assert all(p.num_rows and (sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 10 or p.num_rows == 1) for p in parts)
    assert list(bpe.parted(batch.slice(0, 0))) == []
