"""Removal of repeated word passages by a compacted de Bruijn graph.

A window of ``WINDOW`` consecutive words is a k-mer, an edge of the graph from its first k-1 words to its
last. A word goes if a window that covers it also starts in a document with a smaller id.

1. Rolling hashes over the words pick triggers by content, and k-mers that lead to the same trigger form a
   path of the graph; it can only be shared if its core, the words all its k-mers contain, is.
2. Paths whose core occurs in documents of different ids are kept; those with equal words are one node.
3. Where every occurrence of a node is followed by the same node, and that one is always preceded by it, the
   graph does not branch. Such links are compacted by pointer jumping: each round joins the links with
   themselves, so a path of n nodes hangs on its head after log2(n) rounds.
4. A compacted path has a source, its first occurrence in the least document. The words at the source's and
   the occurrence's coordinates are digested, and only equal digests count as a repeat.
5. Paths that share a core without being equal, the ends of passages, are compared k-mer by k-mer, one entry
   per distinct path; what is found there is taken back to all its places.

All steps are counts and minima by key, with partial results before the shuffle, joins whose other side has one
row per key, and windows over one document.

Edge cases: null and empty texts have no words; a document below ``WINDOW`` words has no window; repeated rows and
other documents with the same id do not remove each other; a document without an id keeps everything and removes
nothing. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import SpanHash, Steps, chunks, once_each, ranges, signed, tidy, words
from cohortspan.llm.windows import beside_text, merged_spans, triggers

WINDOW = 50
# A trigger lies at most so many words into its window.
REACH = 24

PLACE = ("doc_id", "h", "first", "last")


def _place(docs: DataFrame) -> list[T.StructField]:
    ints = [T.StructField(name, T.IntegerType()) for name in ("first", "last")]
    return [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), *ints]


def paths(docs: DataFrame, window: int, reach: int, only_core: bool) -> DataFrame:
    """Paths of k-mers around one trigger: hash of the core and, unless only that is wanted, of all words, and place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, offsets in chunks(batch.column("text")):
                begins, ends, word = words(data, offsets)
                tokens = SpanHash(data)(begins, ends)
                owner, trigger, first, last = triggers(tokens, word, window, reach)
                rows = pa.array(owner + start)
                core = signed(SpanHash(tokens)(trigger, trigger + window - reach + 1))
                if only_core:
                    yield pa.record_batch([core, batch.column("doc_id").take(rows)], names=["core", "doc_id"])
                    continue
                base = word[owner]
                yield pa.record_batch(
                    [
                        core,
                        signed(SpanHash(SpanHash(data, 1)(begins, ends), 1)(first, last + window)),
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array((first - base).astype(np.int32)),
                        pa.array((last - base).astype(np.int32)),
                    ],
                    names=["core", "span", *PLACE],
                )

    fields = [T.StructField("core", T.LongType())]
    fields += [_place(docs)[0]] if only_core else [T.StructField("span", T.LongType()), *_place(docs)]
    return docs.mapInArrow(tidy(found), T.StructType(fields))


def kmers(listed: DataFrame, window: int) -> DataFrame:
    """Every k-mer of the listed paths, with its place and the first k-mer of its path."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            bounds = lists.offsets.to_numpy()
            first, last = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for start, stop, data, offsets in chunks(batch.column("text")):
                begins, ends, word = words(data, offsets)
                low, high = bounds[start], bounds[stop]
                many = last[low:high] - first[low:high] + 1
                owner = np.repeat(np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1])), many)
                path = np.repeat(first[low:high], many)
                at = ranges(first[low:high], many)
                a = at + word[owner]
                rows = pa.array(owner + start)
                yield pa.record_batch(
                    [
                        signed(SpanHash(SpanHash(data)(begins, ends))(a, a + window)),
                        signed(SpanHash(SpanHash(data, 1)(begins, ends), 1)(a, a + window)),
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array(at.astype(np.int32)),
                        pa.array(at.astype(np.int32)),
                        pa.array(path.astype(np.int32)),
                    ],
                    names=["core", "span", *PLACE, "path"],
                )

    fields = [T.StructField("core", T.LongType()), T.StructField("span", T.LongType()), *_place(listed)]
    fields += [T.StructField("path", T.IntegerType())]
    return listed.mapInArrow(tidy(found), T.StructType(fields))


def digests(listed: DataFrame, window: int) -> DataFrame:
    """The digest of the words at each listed place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            bounds = lists.offsets.to_numpy()
            first, last = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for start, stop, data, offsets in chunks(batch.column("text")):
                begins, ends, word = words(data, offsets)
                raw = data.tobytes()
                low, high = bounds[start], bounds[stop]
                owner = np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1]))
                a = begins[first[low:high] + word[owner]]
                b = ends[last[low:high] + word[owner] + window - 1]
                found = [hashlib.md5(b" ".join(raw[x:y].split())).digest() for x, y in zip(a.tolist(), b.tolist())]
                rows = pa.array(owner + start)
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array(first[low:high].astype(np.int32)),
                        pa.array(last[low:high].astype(np.int32)),
                        pa.array(found, pa.binary()),
                    ],
                    names=[*PLACE, "digest"],
                )

    return listed.mapInArrow(tidy(found), T.StructType([*_place(listed), T.StructField("digest", T.BinaryType())]))


def compacted(table: DataFrame, steps: Steps) -> DataFrame:
    """Occurrences of maximal paths without branches: ``path`` (its head) and place."""
    by_place = Window.partitionBy("doc_id", "h").orderBy("first")
    node = table.select(F.xxhash64("core", "span").alias("node"), *PLACE)
    node, _ = steps.store(
        node.withColumns(
            {
                "next": F.when(F.lead("first").over(by_place) == F.col("last") + 1, F.lead("node").over(by_place)),
                "previous": F.when(F.lag("last").over(by_place) + 1 == F.col("first"), F.lag("node").over(by_place)),
            }
        ),
        "nodes",
    )
    stats = node.groupBy("node").agg(
        *(
            F.when(
                (F.min(side) == F.max(side)) & (F.count(side) == F.count("*")), F.min(side)
            ).alias(side)
            for side in ("next", "previous")
        )
    )
    stats, _ = steps.store(stats, "degrees")
    links, path = steps.store(
        stats.where("next IS NOT NULL")
        .select(F.col("node").alias("up"), F.col("next").alias("node"))
        .join(stats.where("previous IS NOT NULL").select("node", "previous"), "node")
        .where("up = previous AND up <> node")
        .select("node", "up"),
        "links",
    )
    # A document ends, so no path without branches runs in a circle and every one has a head.
    while True:
        above = links.select(F.col("node").alias("up"), F.col("up").alias("over"))
        jumped = links.join(above, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved"))
        jumped, new = steps.store(jumped, "links")
        steps.remove(path)
        path = new
        links = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            break
    headed = node.join(links, "node", "left").withColumn("path", F.coalesce("up", "node"))
    starts = (F.col("path") == F.col("node")) | ~F.coalesce(
        (F.lag("path").over(by_place) == F.col("path")) & (F.lag("last").over(by_place) + 1 == F.col("first")), F.lit(False)
    )
    run = F.sum(F.col("start").cast("int")).over(by_place)
    return (
        headed.withColumn("start", starts)
        .withColumn("run", run)
        .groupBy("doc_id", "h", "run")
        .agg(F.first("path").alias("path"), F.min("first").alias("first"), F.max("last").alias("last"))
        .select("path", *PLACE)
    )


def listed_at(docs: DataFrame, places: DataFrame, steps: Steps) -> DataFrame:
    lists = places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("cells"))
    return beside_text(docs, lists, steps, "inner")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, h`` (hash of the text) and ``spans``, the merged word ranges to remove from that text."""
    steps = Steps(docs.sparkSession, "graph")
    reach = max(1, min(REACH, window // 2))
    keyed = once_each(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where("doc_id IS NOT NULL"))
    cores, _ = steps.store(
        paths(keyed, window, reach, True)
        .groupBy("core")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("core"),
        "cores",
    )
    table, _ = steps.store(paths(keyed, window, reach, False).join(cores, "core", "left_semi"), "paths")

    # Compacted paths, verified at the coordinates of their sources.
    runs, _ = steps.store(compacted(table, steps), "runs")
    sources = runs.groupBy("path").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared, _ = steps.store(runs.join(sources.select("path"), "path", "left_semi"), "shared")
    digest = digests(listed_at(keyed, shared, steps), window).distinct()
    verified, _ = steps.store(shared.join(digest, list(PLACE)), "verified")
    source = verified.groupBy("path", "digest").agg(F.min("doc_id").alias("source"))
    whole = verified.join(source, ["path", "digest"]).where("doc_id > source").select(*PLACE)

    # Ends: distinct paths around one core, k-mer by k-mer.
    one = table.groupBy("core", "span").agg(F.min(F.struct(*PLACE)).alias("one"))
    one, _ = steps.store(one, "distinct")
    unclear = (
        one.groupBy("core")
        .agg(F.count("*").alias("n"), F.min("one.doc_id").alias("low"), F.max("one.doc_id").alias("high"))
        .where("n > 1 AND low < high")
    )
    ends = one.join(unclear.select("core"), "core", "left_semi").select("core", "span", "one.*")
    edges, _ = steps.store(kmers(listed_at(keyed, ends, steps), window), "edges")
    least = edges.groupBy("core", "span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    single = edges.join(least.select("core", "span", "low"), ["core", "span"]).where("doc_id > low")
    # What was found in one place of a path holds for its others in that document, and in texts with the same id;
    # `whole` has those in documents with larger ids. A path has at most reach + 1 k-mers.
    offsets = single.groupBy("doc_id", "h", F.col("path").alias("first")).agg(
        F.collect_list(F.col("first") - F.col("path")).alias("offsets")
    )
    offsets = offsets.join(ends, ["doc_id", "h", "first"]).select("core", "span", "doc_id", "offsets")
    single = table.join(offsets, ["core", "span", "doc_id"]).select(
        "doc_id", "h", F.explode(F.transform("offsets", lambda x: F.col("first") + x)).alias("first")
    )
    single = single.select("doc_id", "h", "first", F.col("first").alias("last"))

    places = whole.unionByName(single)
    return merged_spans(
        places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("starts")), window
    )


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its number of words, how many go, and the kept words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in chunks(batch.column("text"), 4 << 20):
                raw = data.tobytes()
                counts, gone, kept = [], [], []
                for row, a, b in zip(range(start, stop), offsets[:-1].tolist(), offsets[1:].tolist()):
                    parts = raw[a:b].split()  # at the white space [\x20\x09-\x0D]
                    counts.append(len(parts))
                    spans = batch.column("spans")[row].as_py() or []
                    for low, high in zip(spans[-2::-2], spans[::-2]):
                        del parts[low:high]
                    gone.append(counts[-1] - len(parts))
                    kept.append(b" ".join(parts))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    steps = Steps(docs.sparkSession, "graph")
    keyed = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(name, T.LongType()) for name in ("n_words", "n_removed")] + [T.StructField("kept", T.StringType())]
    return beside_text(keyed, repeats(docs, window), steps, "left").mapInArrow(tidy(cut), T.StructType(fields))
