"""Embedding whitening on distinct vectors that carry their multiplicity.

Entries become integers, x = floor(scale * c), so equal vectors are equal byte for byte. (The same amount added to every
entry, as in x = floor(1024 * c) + 100000, changes no result: everything here is centred in integers first.) Equal vectors are
grouped first and every later step sees each distinct vector once, with the number of its copies as its weight in the
fit (or a weight of one, which fits the distinct vectors alone). The fit is two passes of sums: weights and weighted
totals S, then the covariance as a matrix product of the weighted, centred block of a batch with the block itself. One
D x D matrix of partial sums per task is added up in Spark; the driver gets the sum and takes its eigenvectors. Each
distinct vector is then projected once, and the rows get the results of their vector by a join.

The deviation of a vector, sum of (n * x - S)^2 over its dimensions, is computed in integers: it is exact at any n, as a
decimal of 38 digits.

Edge cases: rows whose vector is null, empty or holds a null or non-finite entry take no part, as do, in a table of
vectors of several lengths, those that are shorter than the longest. Rows that repeat are rows of their own, before and
after. Rows without an id are fitted and returned. Entries whose integer would leave 62 bits are an error, as is a
covariance that is no longer finite. Components without variance (constant dimensions, fewer distinct vectors than
dimensions) are numbered last; ``whitened`` is null there and they are left out of ``identity_error``. Of several equal
eigenvalues any basis serves; the sign of a component is such that its largest entry is positive. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.llm.common import Steps, text_bytes, tidy

SCALE = 1024
COMPONENTS = 8
# Eigenvalues below this share of the trace are rounding, not variance.
LEAST_SHARE = 1e-12

# Widths in which the bytes of a vector are packed: the least that holds all its entries, so equal vectors pack alike.
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
_LARGEST = float(1 << 62)


def pack(rows: np.ndarray) -> pa.Array:
    """Each row of integers as bytes: width in bytes, then the entries."""
    largest = np.maximum(rows.max(axis=1), -1 - rows.min(axis=1))
    width = np.select([largest <= np.iinfo(kind).max for kind in _WIDTHS], [kind.itemsize for kind in _WIDTHS])
    pieces, order = [], []
    for kind in _WIDTHS:
        at = np.flatnonzero(width == kind.itemsize)
        if len(at):
            lines = np.full((len(at), 1 + kind.itemsize * rows.shape[1]), kind.itemsize, np.uint8)
            lines[:, 1:] = rows[at].astype(kind).view(np.uint8)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(lines.shape[1]), len(at), [None, pa.py_buffer(lines)])
            pieces.append(fixed.cast(pa.binary()))
            order.append(at)
    return pa.concat_arrays(pieces).take(pa.array(np.argsort(np.concatenate(order))))


def unpack(packed: pa.Array, dim: int) -> np.ndarray:
    """The entries of packed vectors, a row each."""
    data, offsets = text_bytes(packed)
    width = data[offsets[:-1]]
    out = np.empty((len(packed), dim), np.int64)
    for kind in _WIDTHS:
        at = np.flatnonzero(width == kind.itemsize)
        if len(at):
            places = offsets[at][:, None] + 1 + np.arange(kind.itemsize * dim)
            out[at] = data[places].view(kind)
    return out


def integers(vectors: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, dim, packed``: floor(scale * entry) of the rows that take part."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            entries = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            unfit = np.append(0, np.cumsum(~np.isfinite(entries)))
            there = (lengths > 0) & (unfit[ends] == unfit[starts])
            for dim in np.unique(lengths[there]):
                at = np.flatnonzero(there & (lengths == dim))
                rows = np.floor(scale * entries[starts[at][:, None] + np.arange(dim)])
                if not (np.abs(rows) < _LARGEST).all():
                    raise OverflowError(f"an entry times {scale} does not fit 62 bits")
                ids = batch.column("id").take(pa.array(at))
                dims = pa.array(np.full(len(at), dim), pa.int32())
                yield pa.record_batch([ids, dims, pack(rows.astype(np.int64))], names=["id", "dim", "packed"])

    schema = T.StructType(
        [
            T.StructField("id", vectors.schema[id_column].dataType),
            T.StructField("dim", T.IntegerType()),
            T.StructField("packed", T.BinaryType()),
        ]
    )
    return vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")).mapInArrow(tidy(packed), schema)


def grouped(rows: DataFrame) -> DataFrame:
    """``packed, copies``: each distinct vector once."""
    return rows.groupBy("packed").agg(F.count("*").alias("copies"))


def weights(batch: pa.RecordBatch, by_copies: bool) -> np.ndarray:
    copies = batch.column("copies").to_numpy()
    return copies if by_copies else np.ones_like(copies)


@dataclass(frozen=True)
class Fit:
    """Number of fitted vectors, their totals per dimension, and all components by falling eigenvalue."""

    n: int
    totals: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def has_variance(self, k: int) -> bool:
        return bool(self.values[k] > LEAST_SHARE * self.trace)


def whole(values: np.ndarray) -> list[int]:
    """Sums of the columns in integers of any size."""
    if np.abs(values).astype(np.float64).sum(axis=0).max(initial=0) < _LARGEST:
        return values.sum(axis=0).tolist()
    return values.astype(object).sum(axis=0).tolist()


def totals(distinct: DataFrame, dim: int, by_copies: bool) -> tuple[int, list[int]]:
    """Weight of all vectors, and per dimension the weighted sum of entries."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            w = weights(batch, by_copies)
            x = unpack(batch.column("packed"), dim)
            if np.abs(x).max(initial=0) * float(w.max(initial=0)) >= _LARGEST:
                x = x.astype(object)
            n += int(w.sum())
            sums = [a + b for a, b in zip(sums, whole(x * w[:, None]))]
        yield pa.record_batch(
            [pa.array(range(dim + 1), pa.int32()), pa.array([*sums, n], pa.decimal128(38, 0))], names=["at", "value"]
        )

    # A row per dimension and task, added up by Spark; dim + 1 numbers reach the driver.
    parts = distinct.mapInArrow(tidy(partial), "at int, value decimal(38,0)")
    sums = {r["at"]: int(r["value"]) for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    return sums.get(dim, 0), [sums.get(k, 0) for k in range(dim)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Entries less their mean, rounded once: the numerator n * x - S is exact."""
    if n * (float(np.abs(x).max(initial=0)) + 1) < _LARGEST and max(map(abs, sums)) < _LARGEST:
        return (x * n - np.array(sums, np.int64)) / float(n)
    return np.array((x.astype(object) * n - np.array(sums, object)) / n, np.float64)


def matrix(blocks: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
    """Sum over the blocks (rows, weights) of the weighted product of each with itself, a row per matrix row."""
    total = np.zeros((size, size))
    for rows, w in blocks:
        total += (rows * w[:, None]).T @ rows
    yield pa.record_batch(
        [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "line"]
    )


def added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' matrices, added up by Spark; the driver gets size * size numbers."""
    entries = parts.select("at", F.posexplode("line").alias("column", "value"))
    sums = entries.groupBy("at", "column").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((size, size))
    total[sums["at"].to_numpy(), sums["column"].to_numpy()] = sums["value"].to_numpy()
    return total


def fit(distinct: DataFrame, dim: int, by_copies: bool = True) -> Fit:
    """Moments of the vectors and the unit eigenvectors of their covariance (divisor n)."""
    n, sums = totals(distinct, dim, by_copies)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from matrix(
            ((centred(unpack(b.column("packed"), dim), n, sums), weights(b, by_copies)) for b in batches), dim
        )

    covariance = added(distinct.mapInArrow(tidy(products), "at int, line array<double>"), dim) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(dim)])
    return Fit(n, sums, np.ascontiguousarray(axes * signs), np.maximum(values, 0.0), float(np.trace(covariance)))


def projected(distinct: DataFrame, found: Fit, components: int) -> DataFrame:
    """``packed, copies, deviation, scores`` of every distinct vector; scores are whitened, NaN without variance."""
    dim = len(found.totals)
    roots = np.array([np.sqrt(found.values[k]) if found.has_variance(k) else np.nan for k in range(components)])
    axes = found.axes[:, :components] / roots

    def deviations(x: np.ndarray) -> list[int]:
        if found.n * (float(np.abs(x).max()) + 1) < _LARGEST and max(map(abs, found.totals)) < _LARGEST:
            off = x * found.n - np.array(found.totals, np.int64)
            if (off.astype(np.float64) ** 2).sum(axis=1).max() < _LARGEST:
                return (off**2).sum(axis=1).tolist()
        off = x.astype(object) * found.n - np.array(found.totals, object)
        return [sum(v * v for v in row) for row in off]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch.column("packed"), dim)
            if not len(x):
                continue
            scores = centred(x, found.n, found.totals) @ axes
            yield pa.record_batch(
                [
                    batch.column("packed"),
                    batch.column("copies"),
                    pa.array(deviations(x), pa.decimal128(38, 0)),
                    pa.array(list(scores), pa.list_(pa.float64())),
                ],
                names=["packed", "copies", "deviation", "scores"],
            )

    schema = "packed binary, copies bigint, deviation decimal(38,0), scores array<double>"
    return distinct.mapInArrow(tidy(scored), schema)


def identity_error(whitened: DataFrame, found: Fit, components: int, by_copies: bool) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    there = [k for k in range(components) if found.has_variance(k)]
    if not there:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                if batch.num_rows:
                    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False)
                    yield scores.reshape(batch.num_rows, -1)[:, there], weights(batch, by_copies)

        yield from matrix(blocks(), len(there))

    parts = whitened.mapInArrow(tidy(products), "at int, line array<double>")
    return float(np.abs(added(parts, len(there)) / found.n - np.eye(len(there))).max())


REPORT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    by_copies: bool = True,
    scale: int = SCALE,
) -> DataFrame:
    """One row per vector and component: the id and the columns of ``REPORT``."""
    spark = vectors.sparkSession
    steps = Steps(spark, "whitening")
    rows = steps.table(integers(vectors, id_column, vector, scale), "integers")
    dim = rows.agg(F.max("dim")).first()[0]
    if dim is None:
        return spark.createDataFrame([], T.StructType([vectors.schema[id_column], *T._parse_datatype_string(REPORT).fields]))
    rows = rows.where(F.col("dim") == dim).drop("dim")
    distinct = steps.table(grouped(rows), "distinct")
    components = min(components, dim)
    found = fit(distinct, dim, by_copies)
    # Stored, so that the join below can split a vector with very many copies: its other side has one row per vector.
    scored = steps.table(projected(distinct, found, components), "scored")
    error = identity_error(scored, found, components, by_copies)
    shares = [float(v / found.trace) if found.trace > 0 else 0.0 for v in found.values[:components]]
    joined = rows.join(scored.drop("copies"), "packed")
    per_component = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.lit(components)),
            lambda k: F.struct(
                k.alias("component"),
                F.nullif(F.get("scores", k - 1), F.lit(float("nan"))).alias("whitened"),
                F.get(F.array(*map(F.lit, shares)), k - 1).alias("explained"),
            ),
        )
    )
    return joined.select(
        F.col("id").alias(id_column), F.lit(found.n).cast("bigint").alias("n"), "deviation", per_component.alias("c")
    ).select(id_column, "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
