"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(64 x). The approximation of a vector is one byte per dimension, the number of
the cell its component falls into; the cells divide the range of all components evenly. A cell's ends give a
lower and an upper bound of an inner product without the vector.

Vectors are stored in blocks with approximations and exact values side by side. A task takes one block of
candidates and the queries' blocks in turn: it scans the approximations for bounds, then reads exact vectors
in the order of their upper bounds and stops at the first bound below the kth best score found. Each block
gives at most k rows per query, and the best k of those are the result. Every vector is searched; there is
no sample and no cap.

Vectors with a component of a million and more are wide: they are stored in 64 bits, in blocks and with cells of
their own, so that a few of them do not spoil the cells of the others, and are searched in the same way.

Edge cases: null vectors, vectors with a null or non-finite component and vectors without components take no
part; vectors of different lengths are not compared. A component beyond 62 bits and a score beyond 64 bits are
errors. Ties go to the smaller vec_id (null last). A repeated row is a candidate of its own, also for a query with
its id, and as a query it has its own ranks. Fewer than k candidates are all returned. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import Steps, tidy

SCALE = 64
K = 20
# Cells per dimension.
CELLS = 32
# Vectors of a block, on average.
CANDIDATES, QUERIES = 4096, 512
# Exact vectors read at a time.
READ = 64
# Scaled components from here on make a vector wide; none may reach the second bound.
LARGEST, WIDEST = 1 << 26, 1 << 62
PACKED = {False: "<i4", True: "<i8"}
# Sums of products are exact in doubles below this.
EXACT = 1 << 53


def integers(vectors: DataFrame, query: Column, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, dim, wide, query, packed``: a number for the row and the integer components, packed as ``PACKED`` says."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims, wide = [], [], []
            for values in batch.column("embedding"):
                array = None
                if values.is_valid and len(values.values) and not values.values.null_count:
                    array = np.floor(scale * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if not np.isfinite(values.values.to_numpy(zero_copy_only=False)).all():
                        array = None
                largest = 0 if array is None else np.abs(array).max()
                if largest >= WIDEST:
                    raise OverflowError(f"a component of {largest / scale:g} does not fit into 64 bits")
                wide.append(bool(largest >= LARGEST))
                out.append(None if array is None else array.astype(PACKED[wide[-1]]).tobytes())
                dims.append(0 if array is None else len(array))
            yield pa.record_batch(
                [
                    batch.column("vec_id").cast(pa.int64()),
                    batch.column("query"),
                    pa.array(dims, pa.int32()),
                    pa.array(wide, pa.bool_()),
                    pa.array(out, pa.binary()),
                ],
                names=["vec_id", "query", "dim", "wide", "packed"],
            )

    rows = vectors.select("vec_id", "embedding", F.coalesce(query, F.lit(False)).alias("query"))
    found = rows.mapInArrow(tidy(packed), "vec_id bigint, query boolean, dim int, wide boolean, packed binary")
    return found.where("packed IS NOT NULL").withColumn("row", F.monotonically_increasing_id())


def blocks(table: DataFrame, name: str, size: int, cells: dict[bool, tuple[int, int]]) -> DataFrame:
    """One row per block: dimension, wide or not, number, row numbers, ids (with a mark for null), approximations, exact
    values. ``cells`` has the lower end and the width of the cells for both kinds of vectors."""

    def gathered(group: pa.Table) -> pa.Table:
        ids = group["vec_id"]
        exact = b"".join(group["packed"].to_pylist())
        wide = group["wide"][0].as_py()
        low, width = cells[wide]
        codes = ((np.frombuffer(exact, PACKED[wide]).astype(np.int64) - low) // width).astype(np.uint8)
        return pa.table(
            {
                "dim": group["dim"].slice(0, 1),
                "wide": group["wide"].slice(0, 1),
                name: group[name].slice(0, 1),
                "rows": pa.array([group["row"].to_numpy().astype("<i8").tobytes()]),
                "ids": pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]),
                "known": pa.array([ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]),
                "codes": pa.array([codes.tobytes()]),
                "exact": pa.array([exact]),
            }
        )

    count = F.ceil(F.count("*") / size).cast("int").alias("blocks")
    counted = table.groupBy("dim", "wide").agg(count)
    dealt = table.join(counted, ["dim", "wide"]).withColumn(name, F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    columns = f"dim int, wide boolean, {name} int, rows binary, ids binary, known binary, codes binary, exact binary"
    dealt = dealt.select("dim", "wide", name, "row", "vec_id", "packed")
    return dealt.groupBy("dim", "wide", name).applyInArrow(gathered, columns)


def bounds(codes: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that the cells allow, for all pairs."""
    low, high = edges[codes], edges[codes + 1] - 1
    positive, negative = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    lower, upper = positive @ low.T + negative @ high.T, positive @ high.T + negative @ low.T
    dim = codes.shape[1]
    if np.abs(queries).max(initial=0) * np.abs(edges).max() * dim >= EXACT:  # make room for rounding
        slack = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * ((dim + 8) * 2.0**-51)
        return lower - slack, upper + slack
    return lower, upper


def fits(exact: np.ndarray, queries: np.ndarray, others: np.ndarray) -> None:
    """Raise if the score of a pair that counts (``others``) may leave 64 bits. Below that, integer products that wrap
    on the way end at the right sum."""
    dim = exact.shape[1]
    if int(np.abs(exact).max(initial=0)) * int(np.abs(queries).max(initial=0)) * dim < 1 << 63:
        return
    a, b = queries.astype(np.float64), exact.astype(np.float64).T
    most = np.abs(a @ b) + np.abs(a) @ np.abs(b) * ((dim + 8) * 2.0**-51)
    if (most[others] >= 2.0**63).any():
        raise OverflowError("the score of two vectors does not fit into 64 bits")


def best(query: np.ndarray, exact: np.ndarray, upper: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best vectors, read in the order of their bounds until that is certain."""
    order = np.argsort(-upper, kind="stable")
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(order), READ):
        if len(scores) == k and upper[order[start]] < scores[-1]:
            break
        read = order[start : start + READ]
        places = np.concatenate([places, read])
        scores = np.concatenate([scores, exact[read] @ query])
        top = np.lexsort((ids[places], -scores))[:k]
        places, scores = places[top], scores[top]
    return places, scores


def search(vectors: DataFrame, query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each row of ``vectors`` that is a ``query``."""
    steps = Steps(vectors.sparkSession, "search")
    table = steps.table(integers(vectors, query, scale), "vectors")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, tuple[int, int]] = {}
        for batch in batches:
            for wide, packed in zip(batch.column("wide").to_pylist(), batch.column("packed").to_pylist()):
                values = np.frombuffer(packed, PACKED[wide])
                low, high = found.get(wide, (values[0], values[0]))
                found[wide] = min(low, values.min()), max(high, values.max())
        yield pa.record_batch(
            [
                pa.array(list(found), pa.bool_()),
                pa.array([int(low) for low, _ in found.values()], pa.int64()),
                pa.array([int(high) for _, high in found.values()], pa.int64()),
            ],
            names=["wide", "low", "high"],
        )

    spans = table.select("wide", "packed").mapInArrow(tidy(sketched), "wide boolean, low bigint, high bigint")
    spans = spans.groupBy("wide").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    cells = {r.wide: (r.low, max(1, -(-(r.high - r.low + 1) // CELLS))) for r in spans.collect()}  # two rows at most
    edges = {wide: low + width * np.arange(CELLS + 1, dtype=np.float64) for wide, (low, width) in cells.items()}

    candidates, _ = steps.store(blocks(table, "c", CANDIDATES, cells), "candidates")
    asked, _ = steps.store(blocks(table.where("query"), "q", QUERIES, cells), "queries")
    count = candidates.groupBy("dim", "wide").agg(F.max("c").alias("most"))
    theirs = asked.withColumnRenamed("wide", "q_wide").join(count, "dim").withColumn("c", F.explode(F.sequence(F.lit(0), "most")))
    pairs = theirs.select(
        "dim", "wide", "c", "q_wide", *(F.col(x).alias(f"q_{x}") for x in ("rows", "ids", "known", "exact"))
    ).join(candidates, ["dim", "wide", "c"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                exact = np.frombuffer(one["exact"], PACKED[one["wide"]]).reshape(-1, one["dim"]).astype(np.int64)
                queries = np.frombuffer(one["q_exact"], PACKED[one["q_wide"]]).reshape(-1, one["dim"]).astype(np.int64)
                codes = np.frombuffer(one["codes"], np.uint8).reshape(exact.shape)
                lower, upper = bounds(codes, edges[one["wide"]], queries.astype(np.float64))
                rows, ids = np.frombuffer(one["rows"], "<i8"), np.frombuffer(one["ids"], "<i8")
                known = np.frombuffer(one["known"], np.uint8)
                ordered = np.where(known == 1, ids, np.iinfo(np.int64).max)
                q_rows, q_ids = np.frombuffer(one["q_rows"], "<i8"), np.frombuffer(one["q_ids"], "<i8")
                fits(exact, queries, q_rows[:, None] != rows[None, :])
                out = []
                for n, query_row in enumerate(q_rows):
                    other = rows != query_row
                    bound = lower[n][other]
                    # Of the lower bounds the kth greatest: nothing below it can be among the k best.
                    floor = np.partition(bound, -k)[-k] if len(bound) > k else -np.inf
                    kept = np.flatnonzero(other & (upper[n] >= floor))
                    places, scores = best(queries[n], exact[kept], upper[n][kept], ordered[kept], k)
                    places = kept[places]
                    out.append((np.full(len(places), query_row), np.full(len(places), q_ids[n]), places, scores))
                q_row, q_id, place, score = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch(
                    [
                        pa.array(q_row),
                        pa.array(q_id),
                        pa.array(rows[place]),
                        pa.array(ids[place], mask=known[place] == 0),
                        pa.array(score),
                    ],
                    names=["q_row", "query_id", "row", "vec_id", "score"],
                )

    found = pairs.mapInArrow(tidy(compared), "q_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


SQL = """
WITH numbered AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n AS q, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM numbered q JOIN numbered c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
