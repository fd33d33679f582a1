"""SAS transport (XPORT, version 5) files as DataFrames.

The format is public: 80-byte header records, one 140-byte description per variable, then rows of
fixed length. Fixed length means a file splits at any row, so one very large file becomes many
tasks, just as many small files do.

Files are planned by Spark in two phases. Its own reader lists them, and tasks read the headers: one stored
row per file says where its rows start and how long they are. From that table come the columns, and spans
of rows that are decoded by further tasks. The driver sees one row per column name, however many files there are.
"""

from __future__ import annotations

import io
import struct
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import cohortspan
from cohortspan.session import cut_lineage

# Send the code of this package to the workers by value, so they need not have it installed.
cloudpickle.register_pickle_by_value(cohortspan)

RECORD = 80
ROWS_PER_PARTITION = 1_000_000
ROWS_PER_BATCH = 50_000
# More spans than this share tasks.
MOST_TASKS = 50_000
# Addresses whose files a task can read in parts. Others come whole from Spark's reader, one task per file.
IN_PARTS = ("", "file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")
# Marks in the header records, and first bytes of a missing number.
NAMESTR_MARK = b"HEADER RECORD*******NAMESTR HEADER RECORD"
OBS_MARK = b"HEADER RECORD*******OBS     HEADER RECORD"
MISSING = b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Variable:
    name: str
    numeric: bool
    length: int
    offset: int


@dataclass(frozen=True)
class Layout:
    variables: tuple[Variable, ...]
    start: int
    width: int
    rows: int


def scheme(path: str) -> str:
    first = path.split("/", 1)[0]
    return first[:-1] if first.endswith(":") else ""


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or address, and the name in it."""
    kind = scheme(path)
    if kind in ("", "file"):
        bare = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + bare.lstrip("/") if bare != path else path
    # Hadoop's names of one store; credentials are those of the worker's environment.
    return fs.FileSystem.from_uri("s3" + path[len(kind) :] if kind in ("s3a", "s3n") else path)


def _open(path: str) -> pa.NativeFile:
    filesystem, name = resolve(path)
    return filesystem.open_input_file(name)


def read_layout(path: str, source: BinaryIO, size: int) -> Layout:
    """Variables, first data byte and number of rows, from the header and the last record alone."""
    head = source.read(RECORD * 8)
    at = head.find(NAMESTR_MARK)
    if at < 0:
        raise ValueError(f"{path} is not a version 5 transport file")
    count = int(head[at + 54 : at + 58])
    begin = at + RECORD
    length = -(-count * 140 // RECORD) * RECORD
    source.seek(begin)
    block = source.read(length + RECORD)
    if not block[length:].startswith(OBS_MARK):
        raise ValueError(f"{path} has no observation header where one is due")
    variables = []
    for i in range(count):
        entry = block[i * 140 : (i + 1) * 140]
        kind, _, field_length, _ = struct.unpack(">hhhh", entry[:8])
        position = struct.unpack(">i", entry[84:88])[0]
        variables.append(Variable(entry[8:16].decode("ascii").strip(), kind == 1, field_length, position))
    start = begin + length + RECORD
    width = sum(v.length for v in variables)
    rows = (size - start) // width if width else 0
    # The last record is padded with blanks; blank rows at the end are padding, not data.
    while rows and rows * width > size - start - RECORD:
        source.seek(start + (rows - 1) * width)
        if source.read(width).strip(b" "):
            break
        rows -= 1
    return Layout(tuple(variables), start, width, rows)


def ibm_to_double(raw: np.ndarray) -> np.ndarray:
    """Big-endian IBM hexadecimal floats (rows of 2 to 8 bytes) as doubles; missing codes as NaN."""
    padded = np.zeros((len(raw), 8), dtype=np.uint8)
    padded[:, : raw.shape[1]] = raw
    bits = padded.view(">u8").ravel().astype(np.uint64)
    mantissa = (bits & np.uint64(0x00FFFFFFFFFFFFFF)).astype(np.float64)
    exponent = ((bits >> np.uint64(56)) & np.uint64(0x7F)).astype(np.int64)
    values = np.ldexp(mantissa, 4 * (exponent - 64) - 56)
    values = np.where(bits >> np.uint64(63), -values, values)
    absent = np.isin(padded[:, 0], np.frombuffer(MISSING, dtype=np.uint8)) & (padded[:, 1:] == 0).all(axis=1)
    return np.where(absent, np.nan, values)


def _field(rows: np.ndarray, variable: Variable) -> pa.Array:
    raw = rows[:, variable.offset : variable.offset + variable.length]
    if variable.numeric:
        return pa.array(ibm_to_double(raw), type=pa.float64(), from_pandas=True)
    texts = np.ascontiguousarray(raw).view(f"S{variable.length}").ravel()
    return pa.array([t.decode("latin-1").rstrip(" ") for t in texts], type=pa.string())


VARIABLES = "array<struct<name: string, numeric: boolean, length: int, offset: int>>"
LAYOUTS = f"path string, start bigint, width int, rows bigint, variables {VARIABLES}"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layouts of files that come as their path and, where they cannot be opened in parts, their content."""
    schema = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("width", pa.int32()), ("rows", pa.int64())]
        + [("variables", pa.list_(pa.struct([("name", pa.string()), ("numeric", pa.bool_()), ("length", pa.int32()), ("offset", pa.int32())])))]
    )
    for batch in batches:
        found = []
        for n, path in enumerate(batch.column("path").to_pylist()):
            if "content" in batch.schema.names:
                content = batch.column("content")[n].as_py()
                layout = read_layout(path, io.BytesIO(content), len(content))
            else:
                with _open(path) as source:
                    layout = read_layout(path, source, source.size())
            found.append({"path": path, **vars(layout), "variables": [vars(v) for v in layout.variables]})
        yield pa.RecordBatch.from_pylist(found, schema=schema)


def _decoder(kinds: dict[str, bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``first`` to ``first + count`` of each file, the columns of ``kinds`` (name to numeric or not)."""
    types = {name: pa.float64() if numeric else pa.string() for name, numeric in kinds.items()}

    def rows_of(span: dict, source: BinaryIO) -> Iterator[pa.RecordBatch]:
        known = {v["name"]: Variable(**v) for v in span["variables"]}
        width, end = span["width"], span["first"] + span["count"]
        for first in range(span["first"], end, ROWS_PER_BATCH):
            count = min(ROWS_PER_BATCH, end - first)
            source.seek(span["start"] + first * width)
            rows = np.frombuffer(source.read(count * width), dtype=np.uint8).reshape(count, width)
            arrays = [_field(rows, known[n]) if n in known else pa.nulls(count, kind) for n, kind in types.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(types))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                span = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                content = span.pop("content", None)
                with io.BytesIO(content) if content is not None else _open(span["path"]) as source:
                    yield from rows_of(span, source)

    return decode


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """``path`` of the transport files below a folder, or of one file of any name, as Spark's reader lists them."""
    path = path.rstrip("/")
    bare = path.removeprefix("file:")
    bare = "/" + bare.lstrip("/") if bare != path else path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.lower("path").endswith(".xpt") | F.col("path").endswith(bare)
    return files.where(named).select("path", *(["content"] if content else []))


def read_layouts(spark: SparkSession, path: str, in_parts: bool = True) -> DataFrame:
    """One stored row per file: where its rows start, their length and number, and its variables."""
    found = list_files(spark, path, content=not in_parts).mapInArrow(_described, LAYOUTS)
    return cut_lineage(found, "xpt-layouts")


def columns_of(layouts: DataFrame) -> dict[str, bool]:
    """Column names in the order of files and variables, and whether they are numbers."""
    each = layouts.select("path", F.posexplode("variables").alias("place", "v"))
    found = each.groupBy(F.col("v.name").alias("name")).agg(
        F.min(F.struct("path", "place")).alias("at"),
        F.min("v.numeric").alias("numeric"),
        F.max("v.numeric").alias("also"),
        F.max(F.when(~F.col("v.numeric"), F.col("path"))).alias("text_in"),
    )
    kinds = {}
    for row in found.orderBy("at").collect():  # as many rows as column names
        if row.numeric != row.also:
            raise ValueError(f"{row.text_in}: {row.name} is a number in one file and a text in another")
        kinds[row.name] = row.numeric
    return kinds


def read_xpt(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
    in_parts: bool | None = None,
) -> DataFrame:
    """A transport file, or a folder of them. With ``columns`` only SEQN and those.

    The columns are those of all files together; a file that lacks one has NULL there. One name for numbers
    and texts is an error. Columns that no file has are left out with a warning. ``in_parts`` says whether tasks
    can open the files themselves, and is decided by the address where it is not given; if not, Spark's reader hands
    them over whole, and a file must fit a task.
    """
    if in_parts is None:
        in_parts = scheme(path) in IN_PARTS
    layouts = read_layouts(spark, path, in_parts)
    total = layouts.agg(F.count("*"), F.sum(F.ceil(F.col("rows") / rows_per_partition))).first()
    if not total[0]:
        raise ValueError(f"no .xpt file in {path}")
    kinds = columns_of(layouts)
    if columns:
        wanted = ["SEQN", *[c for c in columns if c != "SEQN"]]
        absent = [c for c in wanted if c not in kinds]
        if absent:
            warnings.warn(f"{path}: columns not found and left out: {absent}", stacklevel=2)
        kinds = {c: kinds[c] for c in wanted if c in kinds}
    schema = T.StructType([T.StructField(n, T.DoubleType() if numeric else T.StringType()) for n, numeric in kinds.items()])
    known = layouts.where("rows > 0")
    if in_parts:
        span = F.lit(rows_per_partition).cast("bigint")
        firsts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, span)).alias("first")
        spans = known.select("path", "start", "width", "rows", "variables", firsts)
        spans = spans.select("*", F.least(span, F.col("rows") - F.col("first")).alias("count"))
        spans = spans.repartitionByRange(min(max(1, total[1]), MOST_TASKS), "path", "first")
    else:
        whole = known.select("*", F.lit(0).cast("bigint").alias("first"), F.col("rows").alias("count"))
        spans = list_files(spark, path, content=True).join(whole, "path")
    return spans.drop("rows").mapInArrow(_decoder(kinds), schema)
