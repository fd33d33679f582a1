"""Tables kept in buckets of their key, so that an upsert rewrites only the buckets it touches.

A bucketed table is a folder ``rows`` with one directory per bucket, the hash of the key columns modulo the number of
buckets, and a folder ``layout`` with one row that says how it is laid out and the highest id in use. A batch is
reduced to one row per key, its buckets are listed (numbers below the bucket count, nothing else reaches the driver),
the stored rows of those buckets are merged with it, and they replace their directories by a dynamic partition
overwrite. Buckets that the batch does not touch are neither read nor written.

The merged rows are stored in the shared folder before they replace anything. Should the job be lost while directories
are replaced, ``publish`` with that copy brings the table into the state after the batch; it can run any number of times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions.ordinals import numbered
from cohortspan.operators.upsert import upsert
from cohortspan.schemas import NATURAL_KEYS
from cohortspan.session import cut_lineage, scratch

BUCKET = "bucket"

# What a table is cut by: a part of its natural key. No user and no visit has more rows than days and biomarkers allow.
BUCKETED_BY = {
    "users": ["SEQN"],
    "sessions": ["UserID"],
    "anthropometry": ["UserID"],
    "measurements": ["SessionID"],
    "results": ["UserID"],
}
# What an arriving row changes in a stored one, and the id that a new row gets, with the order of new ids.
UPDATED = {
    "users": ["BirthDate", "Sex", "RaceEthnicity"],
    "sessions": ["FastingStatus"],
    "anthropometry": ["HeightCM", "WeightKG", "BMI"],
    "measurements": ["Value"],
    "results": ["BioAgeYears"],
}
IDS = {"users": ("UserID", ["SEQN"]), "sessions": ("SessionID", ["UserID", "SessionDate"])}

_LAYOUT = "BucketCount INT, BucketBy ARRAY<STRING>, Highest BIGINT"


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table: where it is, its columns, what it is cut by and into how many buckets, its highest id."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    by: tuple[str, ...]
    count: int
    highest: int

    def bucket(self) -> Column:
        """Bucket of a row; the key columns take their stored types first, since hashes differ by type."""
        keys = [F.col(c).cast(self.schema[c].dataType) for c in self.by]
        return F.pmod(F.xxhash64(*keys), F.lit(self.count)).cast("int").alias(BUCKET)

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The stored rows with their bucket, of all buckets or of the given ones only."""
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(f"{self.folder}/rows")
        return found if buckets is None else found.where(F.col(BUCKET).isin(list(buckets)))

    def read(self) -> DataFrame:
        return self.rows().drop(BUCKET)


def _write_layout(table: Bucketed) -> None:
    row = [(table.count, list(table.by), table.highest)]
    table.spark.createDataFrame(row, _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{table.folder}/layout")


def _replace(table: Bucketed, rows: DataFrame) -> None:
    """Write ``rows`` in place of what their buckets hold."""
    (
        rows.repartition(BUCKET)
        .sortWithinPartitions(BUCKET, *table.by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(f"{table.folder}/rows")
    )


def create(spark: SparkSession, folder: str, df: DataFrame, by: Sequence[str], count: int, id_column: str | None = None) -> Bucketed:
    """A new bucketed table with the rows of ``df``. ``count`` is best chosen so that a bucket is a few hundred megabytes."""
    table = Bucketed(spark, folder, df.schema, tuple(by), count, 0)
    _replace(table, df.select("*", table.bucket()))
    if id_column is not None:
        table = replace(table, highest=table.read().agg(F.max(id_column)).first()[0] or 0)
    _write_layout(table)
    return table


def open_table(spark: SparkSession, folder: str, schema: T.StructType) -> Bucketed:
    row = spark.read.schema(_LAYOUT).parquet(f"{folder}/layout").first()
    return Bucketed(spark, folder, schema, tuple(row["BucketBy"]), row["BucketCount"], row["Highest"])


def merged(
    table: Bucketed,
    incoming: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    latest_first: Sequence[Column] = (),
    ids: tuple[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, int]:
    """The touched buckets after the batch, stored in the shared folder, and the highest id then in use."""
    typed = [F.col(c).cast(table.schema[c].dataType).alias(c) if c in keys else F.col(c) for c in incoming.columns]
    arrived = cut_lineage(incoming.select(*typed).withColumn(BUCKET, table.bucket()), "arrived")
    touched = [r[BUCKET] for r in arrived.select(BUCKET).distinct().collect()]
    new = upsert(table.rows(touched), arrived, [*keys, BUCKET], update, latest_first)
    highest = table.highest
    if ids is not None:
        name, order = ids
        new = cut_lineage(new, "merged")
        added = numbered(new.where(F.col(name).isNull()).drop(name), name, order, highest + 1)
        added = added.withColumn(name, F.col(name).cast(table.schema[name].dataType)).select(*new.columns)
        new = new.where(F.col(name).isNotNull()).unionByName(added)
    new = cut_lineage(new, "touched-buckets")
    if ids is not None:
        highest = max(highest, new.agg(F.max(ids[0])).first()[0] or 0)
    return new, highest


def publish(table: Bucketed, rows: DataFrame, highest: int, emptied: Sequence[int] = ()) -> Bucketed:
    """Put the touched buckets in place; the same rows may be published again.

    A directory is replaced where ``rows`` has rows for it. Buckets that may have lost all their rows are listed in
    ``emptied``; those of them without rows are removed.
    """
    _replace(table, rows)
    if emptied:
        left = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}
        context = table.spark.sparkContext
        for bucket in set(emptied) - left:
            place = context._jvm.org.apache.hadoop.fs.Path(f"{table.folder}/rows/{BUCKET}={bucket}")
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    table = replace(table, highest=highest)
    _write_layout(table)
    return table


def upsert_into(
    table: Bucketed,
    incoming: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    latest_first: Sequence[Column] = (),
    ids: tuple[str, Sequence[str]] | None = None,
) -> Bucketed:
    """``upsert`` on a bucketed table. ``ids`` names the id column that new rows get a number in, and their order."""
    if not set(table.by) <= set(keys):
        raise ValueError(f"buckets by {table.by} do not follow from the keys {list(keys)}")
    rows, highest = merged(table, incoming, keys, update, latest_first, ids)
    return publish(table, rows, highest)


def create_named(spark: SparkSession, name: str, df: DataFrame, count: int, folder: str | None = None) -> Bucketed:
    """One of the base tables, bucketed as declared above; without a folder, in the shared one."""
    id_column = IDS[name][0] if name in IDS else None
    return create(spark, folder or scratch(spark, f"bucketed-{name}"), df, BUCKETED_BY[name], count, id_column)


def upsert_named(table: Bucketed, name: str, incoming: DataFrame) -> Bucketed:
    """Upsert into a base table by its natural key; ``incoming`` names users and visits by their ids."""
    return upsert_into(table, incoming, NATURAL_KEYS[name], UPDATED[name], ids=IDS.get(name))
