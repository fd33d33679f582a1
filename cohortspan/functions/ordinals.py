"""Numbering rows without putting a large group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.session import cut_lineage


def dense_ordinal(
    df: DataFrame,
    name: str,
    group: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    start: int = 1,
) -> DataFrame:
    """Add ``name`` = position of the row in its group, counted from ``start``.

    ``levels`` are expressions that split a group into consecutive slices, coarse to fine, and that
    never decrease along ``order``. Rows are counted per slice with map-side combine, the counts are
    turned into offsets by windows that see one row per slice, and only the rows of one finest slice
    are sorted together. No task ever holds a whole group, so a hot group is as cheap as many small
    ones. Group and level values must not be NULL; ``numbered`` counts over a whole table.

    ``df`` is read twice, for the counts and for the rows: store it before if it is costly.
    """
    slices = [f"__{name}_{i}" for i in range(len(levels))]
    keys = [*group, *slices]
    cut = df.withColumns(dict(zip(slices, levels)))
    # Said here once, the joins below do not add it in different places; so all levels of the counts
    # come from the same exchange.
    cut = cut.dropna(subset=list(group))
    cut = cut.where(reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in slices]))
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))

    offsets = None
    for depth in range(1, len(slices) + 1):
        outer, inner = [*group, *slices[: depth - 1]], [*group, *slices[:depth]]
        level = counts if depth == len(slices) else counts.groupBy(*inner).agg(F.sum("__n").alias("__n"))
        before = (
            Window.partitionBy(*outer).orderBy(slices[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        )
        level = level.select(*inner, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__o{depth}"))
        offsets = level if offsets is None else offsets.join(level, outer)
    total = sum((F.col(f"__o{d}") for d in range(1, len(slices) + 1)), F.lit(0))
    offsets = offsets.select(*keys, total.alias("__offset"))

    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        cut.join(offsets, keys)
        .withColumn(name, (F.col("__offset") + within + F.lit(start - 1)).cast("long"))
        .drop("__offset", *slices)
    )


def numbered(df: DataFrame, name: str, order: Sequence[str | Column], start: int = 1) -> DataFrame:
    """Add ``name`` = ``start``, ``start`` + 1, ... over the whole table in the given order, NULLs first.

    One range sort deals the rows to tasks. The sorted rows are stored with the number of their task and their
    place in it; rows per task, one small row each, make the offsets. Nothing is assumed to be unique: rows that
    ``order`` does not tell apart are told apart by their place in the stored input, so even one key with most of
    the rows is split over tasks. ``df`` is read once, to be stored; what is sampled and sorted is the stored copy.
    """
    tie, part, place = f"__{name}_tie", f"__{name}_part", f"__{name}_place"
    stored = cut_lineage(df, "unnumbered").withColumn(tie, F.monotonically_increasing_id())
    in_order = cut_lineage(
        stored.orderBy(*order, tie)
        .drop(tie)
        .withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "in-order",
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_order.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    offsets = offsets.select(part, (F.coalesce(F.sum("__n").over(before), F.lit(0)) + start).alias("__offset"))
    # One row per task of the sort: a proven size for the broadcast.
    found = in_order.join(F.broadcast(offsets), part).withColumn(name, F.col("__offset") + F.col(place))
    return found.drop(part, place, "__offset")
