"""The latest values as a stored table that a load brings up to date.

The table holds, per user and biomarker, the rows with the highest time, ties included, in buckets of users. What a
load adds is reduced to its own latest rows first, with a limit per task before the shuffle; these meet the stored rows of
the buckets that its users lie in, and the newest of both are kept. Other buckets are neither read nor written, and the
values behind the table are not looked at again.

A value that comes again for its visit and biomarker replaces the stored one. Where rows disappear or become older, nothing
merged can tell what was second: ``recompute`` takes the users concerned from the full table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.operators import buckets
from cohortspan.operators.views import newest_per_group
from cohortspan.schemas import MEASURED
from cohortspan.session import cut_lineage
from cohortspan.tables import Tables

COLUMNS = ["UserID", "SessionID", "BiomarkerID", "Value", "TakenAt"]
LATEST = T.StructType([T.StructField(c, MEASURED[c].dataType) for c in COLUMNS])


def _newest(values: DataFrame) -> DataFrame:
    return newest_per_group(values, ["UserID", "BiomarkerID"], "TakenAt")


def _typed(values: DataFrame) -> DataFrame:
    return values.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LATEST.fields])


def create(spark: SparkSession, folder: str, values: DataFrame, count: int) -> buckets.Bucketed:
    """A new table from all values with their users, in ``count`` buckets."""
    return buckets.create(spark, folder, _typed(_newest(values.select(*COLUMNS))), ["UserID"], count)


def open_table(spark: SparkSession, folder: str) -> buckets.Bucketed:
    return buckets.open_table(spark, folder, LATEST)


def merge(table: buckets.Bucketed, loaded: DataFrame) -> buckets.Bucketed:
    """Bring in the values of a load (``COLUMNS``), each visit and biomarker at most once in it."""
    arrived = cut_lineage(_typed(_newest(loaded.select(*COLUMNS))).withColumn(buckets.BUCKET, table.bucket()), "loaded")
    touched = [r[buckets.BUCKET] for r in arrived.select(buckets.BUCKET).distinct().collect()]
    # The stored row of a visit and biomarker that comes again is out of date.
    stored = table.rows(touched).join(arrived.select("UserID", "SessionID", "BiomarkerID"), ["UserID", "SessionID", "BiomarkerID"], "left_anti")
    rows = cut_lineage(_newest(stored.select(*arrived.columns).unionByName(arrived)), "latest")
    return buckets.publish(table, rows, table.highest)


def recompute(table: buckets.Bucketed, values: DataFrame, users: DataFrame) -> buckets.Bucketed:
    """Take the rows of ``users`` (UserID) from all values; users without any leave the table."""
    chosen = cut_lineage(users.select(F.col("UserID").cast(LATEST["UserID"].dataType).alias("UserID")).distinct(), "users")
    touched = [r[buckets.BUCKET] for r in chosen.select(table.bucket()).distinct().collect()]
    others = table.rows(touched).join(chosen, "UserID", "left_anti")
    theirs = _typed(_newest(values.select(*COLUMNS).join(chosen, "UserID", "left_semi"))).withColumn(buckets.BUCKET, table.bucket())
    rows = cut_lineage(others.select(*theirs.columns).unionByName(theirs), "latest")
    return buckets.publish(table, rows, table.highest, touched)


def view(table: buckets.Bucketed, t: Tables) -> DataFrame:
    """The stored rows as ``views.latest_measurements`` has them."""
    names = t.biomarkers.select("BiomarkerID", F.col("Name").alias("BiomarkerName"), "Units")
    return table.read().join(names, "BiomarkerID").select(
        "UserID", "BiomarkerID", "Value", "TakenAt", "BiomarkerName", "Units"
    )
