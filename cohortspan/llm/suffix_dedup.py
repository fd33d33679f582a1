"""Removal of every byte that lies in a long string which also starts somewhere else, by prefix-free parsing.

A window is ``WINDOW`` bytes of one document. A rolling hash picks triggers: the place of the least hash
among the first ``REACH`` places of a window. Triggers depend on content alone, so equal windows have their
trigger at the same distance, and the text between triggers makes the phrases of a parse. All windows that
lead to one trigger form a cell, and two strings describe it:

* its core, the bytes that every window with this trigger contains. Two equal windows have equal cores;
* its span, the bytes of all its windows. Cells with equal spans repeat each other as a whole.

The dictionary is the table of distinct (core, span) pairs with their counts. It settles almost all text:
a core met once has no repeated window, a span met twice has only repeated ones. What is left, the ends of
repeats, is one entry per distinct span of a shared core.

The entries of one core meet in a task. What stands before the trigger, the dictionary's part, is sorted from its
end backwards, what follows it, the parse's part, forwards: two suffix arrays with their common lengths between
neighbours. Two entries share the windows for which both common lengths together reach ``WINDOW`` bytes, and the
least common length on the way from one to the other in either order is theirs.

A core with more than ``GROUP`` entries would load a task; its cells are cut into finer ones of ``FINE`` windows and
then into single windows, and each look is a count by hash over all tasks. So repeats of any number cost one entry
per end and not one row per byte or per pair.

Everything else is a count by key, with partial sums before the shuffle, or a join with one row per key. Lists of
cells go back to their texts by broadcast while they are small, by a shuffle beyond that.

Edge cases: null and empty texts have no bytes and nothing is removed; texts below a window keep everything;
repeated rows repeat each other and lose everything from a window on; rows without an id are judged like
others. Strings do not cross documents. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import SpanHash, Steps, chunks, once_each, ranges, signed, text_bytes, tidy
from cohortspan.llm.windows import beside_text, merged_spans, triggers

WINDOW = 400
# A trigger lies at most so many places into its window.
REACH = 192
# Most entries of one core that a task sorts.
GROUP = 256
# Windows of a cell at the second look at larger groups.
FINE = 16

def cells(docs: DataFrame, window: int, reach: int, only_core: bool) -> DataFrame:
    """First look: a row per cell with the hashes of its core and span."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, offsets in chunks(batch.column("text")):
                owner, trigger, first, last = triggers(data, offsets, window, reach)
                hashes = SpanHash(data)
                core = signed(hashes(trigger, trigger + window - reach + 1))
                if only_core:
                    yield pa.record_batch([core], names=["core"])
                    continue
                rows = pa.array(owner + start)
                base = offsets[owner]
                yield pa.record_batch(
                    [
                        core,
                        signed(hashes(first, last + window)),
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array((trigger - base).astype(np.int32)),
                        pa.array((first - base).astype(np.int32)),
                        pa.array((last - base).astype(np.int32)),
                    ],
                    names=["core", "span", "doc_id", "h", "at", "first", "last"],
                )

    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("core", T.LongType())]
    if not only_core:
        fields += [T.StructField("span", T.LongType()), T.StructField("doc_id", kind), T.StructField("h", T.LongType())]
        fields += [T.StructField(name, T.IntegerType()) for name in ("at", "first", "last")]
    return docs.mapInArrow(tidy(found), T.StructType(fields))


def finer(listed: DataFrame, window: int, fine: int) -> DataFrame:
    """A closer look at listed cells: rows per ``fine`` windows; the grid is counted from the trigger."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            ends = lists.offsets.to_numpy()
            at, first, last = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            for start, stop, data, offsets in chunks(batch.column("text")):
                low, high = ends[start], ends[stop]
                owner = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
                base = offsets[owner]
                trigger, a, b = at[low:high] + base, first[low:high] + base, last[low:high] + base
                # Distances to the trigger, from near (last window) to far (first window), by grid cell.
                near, far = (trigger - b) // fine, (trigger - a) // fine
                many = far - near + 1
                cell = np.repeat(np.arange(len(trigger)), many)
                grid = ranges(near, many)
                trigger, owner = trigger[cell], owner[cell]
                a = np.maximum(a[cell], trigger - (grid * fine + fine - 1))
                b = np.minimum(b[cell], trigger - grid * fine)
                hashes, other = SpanHash(data), SpanHash(data, 1)
                core_start, core_end = trigger - grid * fine, trigger - (grid * fine + fine - 1) + window
                core = hashes(core_start, core_end) + grid.astype(np.uint64)
                rows = pa.array(owner + start)
                base = offsets[owner]
                yield pa.record_batch(
                    [
                        signed(core),
                        signed(other(a, b + window)),
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array((trigger - base).astype(np.int32)),
                        pa.array((a - base).astype(np.int32)),
                        pa.array((b - base).astype(np.int32)),
                    ],
                    names=["core", "span", "doc_id", "h", "at", "first", "last"],
                )

    kind = listed.schema["doc_id"].dataType
    fields = [T.StructField("core", T.LongType()), T.StructField("span", T.LongType())]
    fields += [T.StructField("doc_id", kind), T.StructField("h", T.LongType())]
    fields += [T.StructField(name, T.IntegerType()) for name in ("at", "first", "last")]
    return listed.mapInArrow(tidy(found), T.StructType(fields))


def judged(table: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Cells whose span occurs again, and one cell per distinct span where a core leaves questions open."""
    place = ["doc_id", "h", "at", "first", "last"]
    classes, _ = steps.store(
        table.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one")), "classes"
    )
    again = table.join(classes.where("n > 1").select("core", "span"), ["core", "span"], "left_semi")
    unsettled = (
        classes.groupBy("core").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 AND least = 1")
    )
    unclear = classes.select("core", "one").join(unsettled.select("core", "spans"), "core").select("core", "spans", "one.*")
    return again.select("doc_id", "h", "first", "last"), unclear


def entries(listed: DataFrame) -> DataFrame:
    """The bytes of the listed cells' spans, by core."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            lists = batch.column("cells")
            ends = lists.offsets.to_numpy()
            core, at, first, last, window = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            for row in range(batch.num_rows):
                own = slice(ends[row], ends[row + 1])
                base = int(offsets[row])
                low, high = first[own] + base, last[own] + window[own] + base
                count = len(low)
                yield pa.record_batch(
                    [
                        pa.array(core[own]),
                        batch.column("doc_id").take(pa.array(np.full(count, row))),
                        batch.column("h").take(pa.array(np.full(count, row))),
                        pa.array(at[own].astype(np.int32)),
                        pa.array(first[own].astype(np.int32)),
                        pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary()),
                    ],
                    names=["core", "doc_id", "h", "at", "first", "bytes"],
                )

    kind = listed.schema["doc_id"].dataType
    fields = [T.StructField("core", T.LongType()), T.StructField("doc_id", kind), T.StructField("h", T.LongType())]
    fields += [T.StructField(name, T.IntegerType()) for name in ("at", "first")]
    return listed.mapInArrow(tidy(found), T.StructType([*fields, T.StructField("bytes", T.BinaryType())]))


def common_lengths(rows: list[bytes], longest: int) -> np.ndarray:
    """Length of the common beginning of every pair of rows, at most ``longest``, by a suffix array of the rows."""
    count = len(rows)
    if not longest:
        return np.zeros((count, count), np.int64)
    table = np.frombuffer(b"".join(r[:longest].ljust(longest, b"\0") for r in rows), np.uint8).reshape(count, longest)
    order = np.array(sorted(range(count), key=rows.__getitem__))
    differs = table[order[:-1]] != table[order[1:]]
    near = np.where(differs.any(axis=1), differs.argmax(axis=1), longest)
    pairs = np.full((count, count), longest, np.int64)
    for k in range(count - 1):
        least = np.minimum.accumulate(near[k:])
        pairs[order[k], order[k + 1 :]] = least
        pairs[order[k + 1 :], order[k]] = least
    size = np.array([min(len(r), longest) for r in rows])
    return np.minimum(pairs, np.minimum(size[:, None], size[None, :]))


def shared_windows(before: list[bytes], after: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each entry the ranges of distances before the trigger at which it shares a window with another entry.

    ``before``: what stands before the trigger, backwards; ``after``: what follows it.
    """
    left = common_lengths(before, max(map(len, before)))
    right = common_lengths(after, window)
    near = window - right
    shared = near <= left
    np.fill_diagonal(shared, False)
    found = []
    for k in range(len(before)):
        own = np.flatnonzero(shared[k])
        found.append(sorted(set(zip(near[k, own].tolist(), left[k, own].tolist()))))
    return found


def compared(table: DataFrame, window: int) -> DataFrame:
    """Windows that entries of one core share; the entries of a core lie together and sorted."""

    def judge(rows: list[dict]) -> Iterator[tuple]:
        before = [r["bytes"][: r["at"] - r["first"]][::-1] for r in rows]
        after = [r["bytes"][r["at"] - r["first"] :] for r in rows]
        for row, spans in zip(rows, shared_windows(before, after, window)):
            for near, far in spans:
                yield row["doc_id"], row["h"], row["at"] - far, row["at"] - near

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[dict] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            made = pa.record_batch([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=pa.schema(kinds))
            out.clear()
            return made

        kinds: list[pa.Field] = []
        for batch in batches:
            kinds = [
                pa.field("doc_id", batch.schema.field("doc_id").type),
                pa.field("h", pa.int64()),
                pa.field("first", pa.int32()),
                pa.field("last", pa.int32()),
            ]
            for row in batch.to_pylist():
                if group and group[0]["core"] != row["core"]:
                    out.extend(judge(group))
                    group = []
                group.append(row)
            if len(out) > 50_000:
                yield batch_of()
        if group:
            out.extend(judge(group))
        if kinds:
            yield batch_of()

    fields = [T.StructField("doc_id", table.schema["doc_id"].dataType), T.StructField("h", T.LongType())]
    fields += [T.StructField(name, T.IntegerType()) for name in ("first", "last")]
    together = table.repartition("core").sortWithinPartitions("core", "doc_id", "h", "first")
    return together.mapInArrow(tidy(found), T.StructType(fields))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, h`` (hash of the text) and ``spans``, the merged byte ranges to remove from that text."""
    steps = Steps(docs.sparkSession, "repeats")
    reach = max(1, min(REACH, window // 2))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    shared, _ = steps.store(
        cells(keyed, window, reach, True).groupBy("core").count().where("count > 1").select("core"), "cores"
    )
    table, _ = steps.store(cells(keyed, window, reach, False).join(shared, "core", "left_semi"), "cells")
    again, unclear = judged(table, steps)
    unclear, _ = steps.store(unclear, "unclear")
    # All windows of repeated rows do repeat; one of them stands for the others from here on.
    keyed = once_each(keyed)
    # Repeated rows and equal texts without an id have the same cells; the list of a text gets each once.
    found = [again.distinct(), ends_of_groups(keyed, unclear.where(F.col("spans") <= GROUP), window, steps)]
    unclear = unclear.where(F.col("spans") > GROUP)
    if not unclear.isEmpty():
        for fine in (FINE, 1):
            listed = unclear.groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "first", "last")).alias("cells"))
            texts = beside_text(keyed, listed, steps, "inner")
            table, _ = steps.store(finer(texts, window, fine), "cells")
            again, unclear = judged(table, steps)
            found.append(again)
    rows = reduce(DataFrame.unionByName, found)
    return merged_spans(rows.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last")).alias("starts")), window)


def ends_of_groups(keyed: DataFrame, unclear: DataFrame, window: int, steps: Steps) -> DataFrame:
    """Repeated windows among the entries of each core, by suffix arrays."""
    cell = F.struct("core", "at", "first", "last", F.lit(window).alias("window"))
    listed = unclear.groupBy("doc_id", "h").agg(F.collect_list(cell).alias("cells"))
    bytes_of = entries(beside_text(keyed, listed, steps, "inner"))
    return steps.table(compared(bytes_of, window), "ends")


def beside_spans(docs: DataFrame, window: int) -> DataFrame:
    steps = Steps(docs.sparkSession, "repeats")
    return beside_text(docs.withColumn("h", F.xxhash64("text")), repeats(docs, window), steps, "left")


def kept_parts(data: np.ndarray, offsets: np.ndarray, spans: pa.Array) -> Iterator[tuple[bytes, int, int]]:
    """Of each document the bytes that stay, how many go, and in how many runs."""
    raw = data.tobytes()
    for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        cut = spans[row].as_py() or []
        parts, at = [], start
        for a, b in zip(cut[::2], cut[1::2]):
            parts.append(raw[at : start + a])
            at = start + b
        parts.append(raw[at:stop])
        kept = b"".join(parts)
        yield kept, stop - start - len(kept), len(cut) // 2


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed and the digest of what stays."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            removed, runs, digests = [], [], []
            for kept, gone, n in kept_parts(data, offsets, batch.column("spans")):
                removed.append(gone)
                runs.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField("kept_sha256", T.StringType())]
    return beside_spans(docs.select("doc_id", "text"), window).mapInArrow(tidy(counted), T.StructType(fields))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, columns as they were, with repeated passages cut out of ``text``.

    Bytes of a character that a cut has split go too. ``n_chars``, where there is one, follows the text.
    """
    columns = docs.columns
    row = docs.select("doc_id", "text", F.struct(*columns).alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            known = batch.column("text").is_valid().to_pylist()
            texts = [
                kept.decode("utf-8", "ignore") if have else None
                for (kept, _, _), have in zip(kept_parts(data, offsets, batch.column("spans")), known)
            ]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "kept"])

    schema = T.StructType([T.StructField("row", row.schema["row"].dataType), T.StructField("kept", T.StringType())])
    kept = beside_spans(row, window).select("row", "text", "spans").mapInArrow(tidy(cut), schema)
    out = []
    for name in columns:
        if name == "text":
            out.append(F.col("kept").alias("text"))
        elif name == "n_chars":
            whole = F.coalesce(F.char_length("kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
            out.append(F.when(F.col("kept").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(whole).alias(name))
        else:
            out.append(F.col(f"row.`{name}`").alias(name))
    return kept.select(*out)
