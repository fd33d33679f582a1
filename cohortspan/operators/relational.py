"""The plain relational operators that the queries are made of, on the health tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.operators.etl import melt
from cohortspan.operators.views import first_per_group
from cohortspan.tables import Tables


def count_distinct(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Distinct values per group; Spark deduplicates on (group, value) before it counts."""
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def conditional_sum(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows per group that meet each condition."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()])


def minmax_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.min(column).alias("lowest"), F.max(column).alias("highest")
    )


def pivot_max(df: DataFrame, keys: list[str], pivot: str, value: str, labels: dict[str, object]) -> DataFrame:
    """One column per label with the highest value of that pivot entry; the labels are known beforehand."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(pivot) == v, F.col(value))).alias(n) for n, v in labels.items()])


def unpivot(df: DataFrame, key: str, names: str, values: str) -> DataFrame:
    return melt(df, key, names, values)


def union_all(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for df in frames[1:]:
        result = result.unionByName(df)
    return result


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_per_group(df, keys, order)


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group with their position; map tasks keep ``k`` candidates each."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", number).where(F.col("position") <= k)


def having_match(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def without_match(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def measured_visits(t: Tables) -> DataFrame:
    """Measurements with their visit."""
    return t.measurements.join(t.sessions.select("SessionID", "UserID", "SessionDate", "FastingStatus"), "SessionID")
