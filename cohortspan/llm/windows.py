"""Windows of a fixed number of symbols: cells of windows around content-defined triggers, and their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import SpanHash, Steps, ranges, tidy

# Symbols of the rolling hash.
ROLL = 16
# Lists up to this size go to the texts by broadcast, larger ones by a shuffle.
BROADCAST_BYTES = 48 << 20


def triggers(data: np.ndarray, offsets: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """Cells of the texts: document, trigger, first and last window start (all in ``data``)."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    starts = ranges(offsets[:-1], np.maximum(size - window + 1, 0))
    if not len(starts):
        return none, none, none, none
    roll = min(ROLL, window - reach + 1)
    n = len(data)
    bits = np.uint64(max(1, int(n).bit_length()))
    at = np.arange(n - roll + 1)
    keys = np.full(-(-n // reach) * reach + reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[: len(at)] = (SpanHash(data)(at, at + roll) >> bits << bits) | at.astype(np.uint64)
    # Least key of every run of ``reach`` places: the end of one block and the beginning of the next.
    blocks = keys.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[starts], ahead[starts + reach - 1])
    trigger = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), np.maximum(size - window + 1, 0))
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], trigger[first], starts[first], starts[last]


def beside_text(docs: DataFrame, lists: DataFrame, steps: Steps, how: str) -> DataFrame:
    """Documents with their list; the lists go by broadcast if their stored size is small."""
    stored, path = steps.store(lists, "lists")
    side = stored.withColumnsRenamed({"doc_id": "listed_id", "h": "listed_h"})
    if steps.size(path) <= BROADCAST_BYTES // 4:  # stored lists are compressed
        side = F.broadcast(side)
    matches = F.col("doc_id").eqNullSafe(F.col("listed_id")) & (F.col("h") == F.col("listed_h"))
    return docs.join(side, matches, how).drop("listed_id", "listed_h")


def merged_spans(lists: DataFrame, window: int) -> DataFrame:
    """``doc_id, h, spans`` from lists of window starts: flat, sorted [start, end) pairs of what windows cover."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts in batch.column("starts"):
                a = starts.values.field(0).to_numpy(zero_copy_only=False)
                b = starts.values.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + window
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(a)) - 1
                out.append(np.stack([a[first], b[last]], axis=1).reshape(-1).astype(np.int32))
            values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32))
            ends = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("h"), pa.ListArray.from_arrays(ends, values)],
                names=["doc_id", "h", "spans"],
            )

    fields = [T.StructField("doc_id", lists.schema["doc_id"].dataType), T.StructField("h", T.LongType())]
    return lists.mapInArrow(tidy(merged), T.StructType([*fields, T.StructField("spans", T.ArrayType(T.IntegerType()))]))
