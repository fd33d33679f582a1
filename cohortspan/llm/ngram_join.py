"""Near duplicates: a self-join on the Jaccard similarity of word n-gram sets, with MinHash banding.

1. Documents with the same words form a class of copies; one of them, the least id, stands for it.
2. MinHash values of its n-gram set, in bands, are the class's keys. The band and row counts give the
   recall wanted at the threshold; keys are shuffled as single numbers.
3. Classes that share a key are candidates. They are linked to the least class of the key, never pair by
   pair, and the connected components of these links hold every candidate pair.
4. Components are dealt out in blocks of bounded size, and pairs of blocks compare the full n-gram
   sets of their members. Only counts and a spanning forest leave a task, so a group of m near copies
   makes about m rows per block and not m^2.

Edge cases: texts shorter than ``n`` words have one n-gram, all their words; a document without words
has no links and is its own class. A document without an id takes part as a copy of others only.
Repeated rows are copies. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import SpanHash, Steps, chunks, ranges, signed, tidy, words
from cohortspan.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
# Chance that a pair at the threshold shares no key.
MISSES = 1e-5
ROWS = 6
# Start of every key; the band's number is added.
SEED = np.uint64(0x51ED270B0A1F39C1)
# A block of a component: so many classes and so many bytes of text, on average.
BLOCK_CLASSES = 512
BLOCK_BYTES = 4 << 20


def bands_for(threshold: float, rows: int, misses: float) -> int:
    """Bands of ``rows`` values that miss a pair at the threshold with at most the given chance."""
    return max(1, math.ceil(math.log(misses) / math.log1p(-(threshold**rows))))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, how many each document has, two hashes of all its words, its words."""
    starts, ends, first = words(data, offsets)
    tokens = SpanHash(data)(starts, ends)
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = ranges(first[:-1], grams)
    hashes = SpanHash(tokens)
    whole = hashes(first[:-1], first[1:]), SpanHash(SpanHash(data, 1)(starts, ends), 1)(first[:-1], first[1:])
    end = np.minimum(at + n, np.repeat(first[1:], grams))
    return hashes(at, end), grams, np.stack(whole), counts


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, number of words, two hashes of the words, band keys."""
    rng = np.random.RandomState(20)
    factors = rng.randint(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.randint(0, 1 << 63, bands * rows, dtype=np.uint64)

    def signed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in chunks(batch.column("text"), 1 << 19):
                grams, counts, whole, n_words = shingles(data, offsets, n)
                have = counts > 0
                keys = np.zeros((int(have.sum()), bands), dtype=np.uint64)
                if len(grams):
                    at = (np.cumsum(counts) - counts)[have]
                    value = np.empty_like(grams)
                    for band in range(bands):
                        key = SEED + np.uint64(band)
                        for k in range(band * rows, (band + 1) * rows):
                            np.multiply(grams, factors[k], out=value)
                            value += shifts[k]
                            key = (key ^ np.minimum.reduceat(value, at)) * factors[k]
                            key ^= key >> np.uint64(29)
                        keys[:, band] = key
                ends = np.concatenate([[0], np.cumsum(have * bands)])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(start, stop - start).cast(pa.int64()),
                        pa.array(n_words.astype(np.int64)),
                        signed(whole[0]),
                        signed(whole[1]),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(keys.reshape(-1))),
                    ],
                    names=["doc_id", "n_words", "h1", "h2", "n_bytes", "keys"],
                )

    schema = "doc_id bigint, n_words bigint, h1 bigint, h2 bigint, n_bytes bigint, keys array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(tidy(signed_batches), schema)


def compare(n: int, threshold: float):
    """The comparison of one pair of blocks: for every class with links, its links and its local group."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        reps = table["rep"].to_numpy()
        copies = table["copies"].to_numpy().astype(np.float64)
        side = table["side"].to_numpy()
        parts, counts = [], []
        for _, _, data, offsets in chunks(table["text"]):
            grams, sizes, _, _ = shingles(data, offsets, n)
            parts.append(grams)
            counts.append(sizes)
        gram, size = np.concatenate(parts), np.concatenate(counts)
        owner = np.repeat(np.arange(len(reps)), size)
        order = np.lexsort((owner, gram))
        gram, owner = gram[order], owner[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner = gram[fresh], owner[fresh]
        size = np.bincount(owner, minlength=len(reps)).astype(np.float64)
        number = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]])) - 1
        shared = np.bincount(number)[number] >= 2
        owner, number = owner[shared], number[shared]
        if len(number):
            number = np.cumsum(np.concatenate([[0], (number[1:] != number[:-1]).astype(np.int64)]))
        inter = np.zeros((len(reps), len(reps)), np.float64)
        width = max(64, (1 << 21) // len(reps))
        total = int(number[-1]) + 1 if len(number) else 0
        for start in range(0, total, width):
            low, high = np.searchsorted(number, [start, start + width])
            part = np.zeros((len(reps), min(width, total - start)), np.float32)
            part[owner[low:high], number[low:high] - start] = 1
            inter += part @ part.T
        union = size[:, None] + size[None, :] - inter
        linked = inter / np.maximum(union, 1) >= threshold
        np.fill_diagonal(linked, False)
        if side.any():  # two different blocks: pairs within a block are compared elsewhere
            linked &= side[:, None] != side[None, :]
        group = np.arange(len(reps))
        while True:
            least = np.minimum(group, np.where(linked, group[None, :], len(reps)).min(axis=1))
            least = least[least]
            if (least == group).all():
                break
            group = least
        hit = linked.any(axis=1)
        return pa.table(
            {
                "rep": pa.array(reps[hit]),
                "least": pa.array(reps[group[hit]]),
                "links": pa.array((linked @ copies)[hit].astype(np.int64)),
                "texts": pa.array(linked.sum(axis=1)[hit].astype(np.int64)),
            }
        )

    return verify


def near_duplicates(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, rows: int = ROWS, misses: float = MISSES
) -> DataFrame:
    """One row per document: its class and its links at ``threshold`` and above.

    ``class_id``: the least doc_id of all documents connected by links. ``n_links``: other documents
    that are linked, copies included. ``n_text_links``: linked texts that differ from its own.
    ``n_copies``: documents with its words, itself included.
    """
    steps = Steps(docs.sparkSession, "ngrams")
    sig = steps.table(signatures(docs, n, bands_for(threshold, rows, misses), rows), "signatures")
    ident = ["n_words", "h1", "h2"]
    classes = sig.where("n_words > 0").groupBy(*ident).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes, _ = steps.store(classes, "classes")
    reps = classes.where("rep IS NOT NULL").select("rep", "copies")
    keyed = (
        sig.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    )
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    candidates = keyed.join(shared.select("key", "low"), "key").where("rep <> low").select("rep", "low").distinct()
    groups = connected_components(candidates.select(F.col("rep").alias("a"), F.col("low").alias("b")), steps)

    # Blocks: a component of one block is compared in one task, a larger one block against block.
    length = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    member = (
        groups.select(F.col("node").alias("doc_id"), F.col("label").alias("part"))
        .join(length, "doc_id")
        .join(reps.select(F.col("rep").alias("doc_id"), "copies"), "doc_id")
    )
    size = member.groupBy("part").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.lit(1)
        ).cast("int").alias("blocks")
    )
    member, _ = steps.store(
        member.join(size, "part")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .select("doc_id", "part", "copies", "blocks", "block"),
        "members",
    )
    dealt = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(member, "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("doc_id").alias("rep"),
            "copies",
            "text",
            "part",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        )
    )
    verified, _ = steps.store(
        dealt.groupBy("part", "i", "j").applyInArrow(
            compare(n, threshold), "rep bigint, least bigint, links bigint, texts bigint"
        ),
        "links",
    )
    found = connected_components(verified.select(F.col("rep").alias("a"), F.col("least").alias("b")), steps)
    counts = verified.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    per_class = (
        classes.join(counts, "rep", "left")
        .join(found.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .select(*ident, "rep", "copies", "links", "texts", "label")
    )
    return sig.select("doc_id", *ident).join(per_class, ident, "left").select(
        "doc_id",
        F.coalesce("label", "rep", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0).cast("bigint")).alias("n_text_links"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("n_copies"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, columns as they were, with only the least id of every class of near duplicates.

    Of repeated rows (same id and text) one stays; documents without an id stay.
    """
    steps = Steps(docs.sparkSession, "ngrams")
    classes = steps.table(near_duplicates(docs), "classes")
    # Stored, so that Spark plans by the size of what goes, not of all classes: texts move only where that is large.
    gone = steps.table(classes.where("class_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    again = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
