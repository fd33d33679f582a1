"""Pieces the corpus operators share: text batches as byte arrays, vectorised hashing, stored steps."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import cohortspan
from cohortspan.session import scratch

# Send the code of this package to the workers by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(cohortspan)

# Bytes of text worked on at a time inside a task; one longer document is worked on alone.
CHUNK_BYTES = 1 << 19

# Bases of the two polynomial hashes; odd, so that they can be inverted modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

# White space that ends a word: [\x20\x09-\x0D].
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all tasks it runs."""
    holder = sys.modules.setdefault("_cohortspan_worker", types.ModuleType("_cohortspan_worker"))
    return holder.__dict__.setdefault(name, {})


# Names of worker caches that can take a hundred megabytes.
MEMORIES = ("bpe", "pieces")


def drop_memories() -> None:
    """Let go of what token operators remember: a worker lives on for other operators."""
    for name in MEMORIES:
        worker_cache(name).clear()


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` on the batches of a task, after which the worker gives freed memory back to the system.

    Workers wait for further tasks beside the executor; what they have freed but keep counts as theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    drop_memories()
    data, offsets = text_bytes(column)
    rows, start = len(offsets) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(family: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache("powers")
    if family not in kept or len(kept[family][0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        base = np.uint64(BASES[family])
        inverse = np.uint64(pow(BASES[family], -1, 1 << 64))
        tables = []
        for factor in (base, inverse):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        kept[family] = (tables[0], tables[1])
    return kept[family]


class SpanHash:
    """64-bit hashes of any spans of a symbol array, each in constant time, from one running sum."""

    def __init__(self, symbols: np.ndarray, family: int = 0):
        n = len(symbols)
        powers, self.inverse = _powers(family, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and, per document, its first word's number."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ... of each range, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different texts of spans of UTF-8 bytes and, per span, the number of its text."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    spans = np.ascontiguousarray(data if offsets[-1] == len(data) else data[ranges(starts, length)])
    column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(spans))
    found = pc.dictionary_encode(column)
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().astype(np.int64)


def assembled(packed: list[bytes], numbers: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Per text, the 32-bit ids packed for its spans, one after the other; ``first`` counts the spans before each text."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ids = np.frombuffer(b"".join(packed), "<u4")
    counts = sizes[numbers]
    raw = ids[ranges((np.cumsum(sizes) - sizes)[numbers], counts)].tobytes()
    at = (4 * np.concatenate([[0], np.cumsum(counts)])[first]).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


class Steps:
    """Tables a job writes into the shared folder and reads again; removed when the job is done with them.

    A written table cuts the lineage and survives lost executors. The result of an operator may still
    read some, so an operator removes only what a later step has replaced.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label

    def store(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.store(df, name)[0]

    def _place(self, path: str):
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(context._jsc.hadoopConfiguration())

    def size(self, path: str) -> int:
        """Bytes of a stored table."""
        place, system = self._place(path)
        return system.getContentSummary(place).getLength()

    def remove(self, path: str) -> None:
        place, system = self._place(path)
        system.delete(place, True)


def numbered(df: DataFrame, order: list[Column | str], steps: Steps, name: str) -> DataFrame:
    """The rows with their number 0, 1, 2, ... in the given order, from one range sort.

    The sorted rows are stored with their place in their partition; the counts per partition, one small
    row each, give where a partition starts.
    """
    sorted_rows = df.orderBy(*order).withColumns(
        {
            "_part": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    stored = steps.table(sorted_rows, "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition: a proven size for the broadcast.
    return stored.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop(
        "_part", "_row", "_before"
    )


def once_each(keyed: DataFrame) -> DataFrame:
    """``keyed`` (doc_id, text, h) without repeated rows; only where an id does repeat are the texts moved for it."""
    repeated = keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return keyed if repeated.isEmpty() else keyed.dropDuplicates(["doc_id", "h"])
