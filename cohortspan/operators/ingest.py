"""New visits from submissions: validate, accept whole submissions, give a reason for the rest.

A submission is a header (SubmissionID, UserID, SessionDateText, FastingStatus) and any number of
values (SubmissionID, BiomarkerID, Value), or one nested record that ``flatten`` takes apart. Values are
reduced to one row of findings per submission with map-side combine; they are never gathered into a list.

A submission may be delivered several times: there is one decision per SubmissionID. Equal headers
count as one, and a value that comes as often as the header as one value. Headers that disagree are
rejected, and so is a header without an id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.dates import iso_date
from cohortspan.operators.etl import assign_ids
from cohortspan.session import cut_lineage

# Reasons, in the order in which they are looked for.
INVALID_VALUE = "invalid_value"
INVALID_DATE = "invalid_date"
UNKNOWN_USER = "unknown_user"
DUPLICATE_SESSION = "duplicate_session"
UNKNOWN_BIOMARKER = "unknown_biomarker"
NULL_VALUE = "null_value"
REPEATED_BIOMARKER = "repeated_biomarker"
CONFLICTING = "conflicting_submission"

_HEADER = ["SubmissionID", "UserID", "SessionDateText", "FastingStatus"]


@dataclass(frozen=True)
class Ingested:
    sessions: DataFrame
    measurements: DataFrame
    rejected: DataFrame


def flatten(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and values of nested bodies: SubmissionID, UserID, sessionDate, fastingStatus and measurements, a
    list of {biomarkerId, value}.

    A body without a list of measurements loses its date and so is rejected as incomplete; an empty list is a visit
    without values.
    """
    listed = F.col("measurements").isNotNull()
    headers = bodies.select(
        "SubmissionID",
        "UserID",
        F.when(listed, F.col("sessionDate")).alias("SessionDateText"),
        F.col("fastingStatus").alias("FastingStatus"),
    )
    values = bodies.select("SubmissionID", F.explode("measurements").alias("m")).select(
        "SubmissionID", F.col("m.biomarkerId").alias("BiomarkerID"), F.col("m.value").alias("Value")
    )
    return headers, values


def _one_per_id(submissions: DataFrame) -> DataFrame:
    """Headers brought to one per SubmissionID, with the number of deliveries and whether they disagree."""
    body = F.struct("UserID", "SessionDateText", "FastingStatus")
    merged = (
        submissions.where("SubmissionID IS NOT NULL")
        .groupBy("SubmissionID")
        .agg(F.min(body).alias("low"), F.max(body).alias("high"), F.count(F.lit(1)).alias("Deliveries"))
        .select("SubmissionID", "low.*", "Deliveries", (~F.col("low").eqNullSafe(F.col("high"))).alias("Conflict"))
    )
    nameless = submissions.where("SubmissionID IS NULL").select(
        *_HEADER, F.lit(1).cast("bigint").alias("Deliveries"), F.lit(False).alias("Conflict")
    )
    return merged.unionByName(nameless)


def _findings(values: DataFrame, biomarkers: DataFrame) -> DataFrame:
    """Per submission: does it name an unknown biomarker, lack a value, and how often does a biomarker come."""
    known = biomarkers.select("BiomarkerID", F.lit(True).alias("Known"))
    per_biomarker = (
        values.withColumn("Value", F.col("Value").try_cast("decimal(12,4)"))
        .groupBy("SubmissionID", "BiomarkerID")
        .agg(F.count(F.lit(1)).alias("Times"), F.max(F.col("Value").isNull()).alias("NoValue"))
        .join(known, "BiomarkerID", "left")
    )
    return per_biomarker.groupBy("SubmissionID").agg(
        F.max(F.col("Known").isNull()).alias("Unknown"),
        F.max("NoValue").alias("NoValue"),
        F.max("Times").alias("Times"),
    )


def visit_time(date: Column, ingested_at: str) -> Column:
    """The given day at the time of day of ``ingested_at``."""
    moment = F.lit(ingested_at).cast("timestamp")
    time_of_day = F.unix_timestamp(moment) - F.unix_timestamp(F.to_date(F.lit(ingested_at)).cast("timestamp"))
    return F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + time_of_day)


def ingest(
    submissions: DataFrame,
    values: DataFrame,
    users: DataFrame,
    sessions: DataFrame,
    biomarkers: DataFrame,
    ingested_at: str = "2001-12-31 00:00:00",
    first_session_id: int | None = None,
) -> Ingested:
    """Accepted visits and values, and rejected submissions with a reason.

    Of several acceptable submissions for one user and date the lowest SubmissionID wins. A value is
    taken at the visit's date and the time of day of ``ingested_at``. New ids count from
    ``first_session_id``, by default from the highest stored id.

    The checked headers are read several times (to find winners, to number, to report), so they are
    stored once in between; the values are not.
    """
    checked = (
        _one_per_id(submissions)
        .withColumn("SessionDate", iso_date(F.col("SessionDateText")))
        .join(users.select("UserID", F.lit(True).alias("UserKnown")), "UserID", "left")
        .join(
            sessions.select("UserID", "SessionDate", F.lit(True).alias("Stored")), ["UserID", "SessionDate"], "left"
        )
        .join(_findings(values, biomarkers), "SubmissionID", "left")
        .withColumn("Repeated", F.col("Times") > F.col("Deliveries"))
    )
    no = F.lit(False)
    checked = checked.withColumns(
        {
            "Incomplete": F.coalesce(F.col("SessionDateText"), F.lit("")).eqNullSafe("")
            | F.col("FastingStatus").isNull()
            | F.col("SubmissionID").isNull(),
            "BadValues": F.coalesce(F.col("Unknown"), no)
            | F.coalesce(F.col("NoValue"), no)
            | F.coalesce(F.col("Repeated"), no)
            | F.col("Conflict"),
        }
    )
    checked = cut_lineage(
        checked.select(*_HEADER, "SessionDate", "UserKnown", "Stored", "Unknown", "NoValue", "Repeated", "Conflict", "Incomplete", "BadValues")
    )
    acceptable = (
        ~F.col("Incomplete")
        & F.col("SessionDate").isNotNull()
        & F.col("UserKnown").isNotNull()
        & F.col("Stored").isNull()
        & ~F.col("BadValues")
    )
    winners = (
        checked.where(acceptable).groupBy("UserID", "SessionDate").agg(F.min("SubmissionID").alias("Winner"))
    )
    judged = checked.join(winners, ["UserID", "SessionDate"], "left")
    taken = F.col("Stored").isNotNull() | (F.col("Winner") < F.col("SubmissionID"))
    reason = (
        F.when(F.col("Conflict"), CONFLICTING)
        .when(F.col("Incomplete"), INVALID_VALUE)
        .when(F.col("SessionDate").isNull(), INVALID_DATE)
        .when(F.col("UserKnown").isNull(), UNKNOWN_USER)
        .when(F.coalesce(taken, no), DUPLICATE_SESSION)
        .when(F.col("Unknown"), UNKNOWN_BIOMARKER)
        .when(F.col("NoValue"), NULL_VALUE)
        .when(F.col("Repeated"), REPEATED_BIOMARKER)
    )
    judged = cut_lineage(judged.select(*_HEADER, "SessionDate", reason.alias("Reason")))

    if first_session_id is None:
        first_session_id = (sessions.agg(F.max("SessionID")).first()[0] or 0) + 1
    accepted = assign_ids(judged.where("Reason IS NULL"), "SessionID", ["SubmissionID"], first_session_id)
    taken_at = visit_time(F.col("SessionDate"), ingested_at)
    accepted = accepted.select(
        "SubmissionID", F.col("SessionID").cast("int").alias("SessionID"), "UserID", "SessionDate", "FastingStatus"
    )
    delivered = values.select("SubmissionID", "BiomarkerID", "Value").distinct()
    measured = delivered.join(
        accepted.select("SubmissionID", "SessionID", taken_at.alias("TakenAt")), "SubmissionID"
    ).select(
        "SubmissionID", "SessionID", "BiomarkerID", F.col("Value").try_cast("decimal(12,4)").alias("Value"), "TakenAt"
    )
    rejected = judged.where("Reason IS NOT NULL").select(*_HEADER, "Reason")
    return Ingested(accepted, measured, rejected)
