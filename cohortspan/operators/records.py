"""The full data model: rows with an id of their own and the time they were stored.

Operators match on natural keys and do not look at these columns; tables keep them for what refers to a row by its
id and for what asks how new it is. Ids are 64 bits wide, without gaps, and follow the natural key, so they depend on the
data only. A row that has an id or a time keeps it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.etl import assign_ids, fill_ids
from cohortspan.operators.ingest import Ingested
from cohortspan.schemas import CREATED, NATURAL_KEYS, RECORD_IDS, RECORDS
from cohortspan.session import cut_lineage
from cohortspan.tables import Tables


def as_record(df: DataFrame, name: str, created: str) -> DataFrame:
    """Rows of the table ``name`` with their id and time; ``created`` is an SQL expression over the row."""
    moment = F.expr(created).cast("timestamp")
    df = df.withColumn(CREATED, F.coalesce(F.col(CREATED), moment) if CREATED in df.columns else moment)
    key = RECORD_IDS.get(name)
    if key is not None:
        df = fill_ids(df, key, NATURAL_KEYS[name]) if key in df.columns else assign_ids(df, key, NATURAL_KEYS[name])
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS[name].fields])


def as_records(t: Tables, created: Mapping[str, str], otherwise: str) -> Tables:
    """All tables with ids and times; a table is numbered when it is first used."""
    return t.replace(
        **{name: partial(lambda n: as_record(getattr(t, n), n, created.get(n, otherwise)), name) for name in t.names()}
    )


def append_records(stored: DataFrame, new: DataFrame, name: str, created_at: str) -> DataFrame:
    """The rows of ``new`` as records behind the stored ones: next free ids, stored at ``created_at``.

    One value, the highest id, is fetched; stored rows are not moved or written again.
    """
    plain = new.drop(CREATED, *([RECORD_IDS[name]] if name in RECORD_IDS else []))
    moment = plain.withColumn(CREATED, F.lit(created_at).cast("timestamp"))
    key = RECORD_IDS.get(name)
    if key is not None:
        highest = stored.agg(F.max(key)).first()[0] or 0
        moment = assign_ids(moment, key, NATURAL_KEYS[name], highest + 1)
    return moment.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS[name].fields])


def replies(done: Ingested, stored: DataFrame, created_at: str) -> DataFrame:
    """What each accepted submission is answered: its visit, and the ids of its values in the order of biomarkers.

    A submission holds a biomarker once, so a list has at most as many entries as there are biomarkers.
    """
    accepted = cut_lineage(done.sessions.select("SubmissionID", "SessionID"), "accepted")
    records = append_records(stored, done.measurements.drop("SubmissionID"), "measurements", created_at)
    ids = records.groupBy("SessionID").agg(F.sort_array(F.collect_list("MeasurementID")).alias("measurementIds"))
    none = F.array().cast("array<bigint>")
    found = accepted.join(ids, "SessionID", "left").withColumn("measurementIds", F.coalesce("measurementIds", none))
    return found.select("SubmissionID", F.col("SessionID").alias("sessionId"), "measurementIds")
