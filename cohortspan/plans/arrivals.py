"""Registered ingestion of submissions, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.operators.ingest import Ingested, ingest
from cohortspan.operators.records import as_record, replies
from cohortspan.plans.define import MATERIALIZED, PARTS, query
from cohortspan.session import scratch
from cohortspan.sources.star import STORED_AT, derive, survey_tables
from cohortspan.streaming.arrivals import ingest_stream

# Visits before this day are stored already; all orders arrive as submissions.
KNOWN_UNTIL = "1998-07-01"
INGESTED_AT = "2001-12-31 08:30:00"

PARTS["known_sessions"] = (("sessions",), f"SELECT * FROM sessions WHERE SessionDate < DATE '{KNOWN_UNTIL}'")
PARTS["findings"] = (
    ("submitted_value", "biomarkers"),
    """SELECT v.SubmissionID, bool_or(b.BiomarkerID IS NULL) AS Unknown, bool_or(v.Value IS NULL) AS NoValue,
  COUNT(*) > COUNT(DISTINCT v.BiomarkerID) AS Repeated FROM submitted_value v
  LEFT JOIN biomarkers b ON b.BiomarkerID = v.BiomarkerID GROUP BY v.SubmissionID""",
)
PARTS["checked"] = (
    ("submission", "users", "known_sessions", "findings"),
    """SELECT s.*, u.UserID IS NOT NULL AS UserKnown, k.SessionID IS NOT NULL AS Stored,
    coalesce(f.Unknown, FALSE) AS Unknown, coalesce(f.NoValue, FALSE) AS NoValue, coalesce(f.Repeated, FALSE) AS Repeated
  FROM (SELECT *, CASE WHEN SessionDateText <> 'not-a-date' THEN CAST(SessionDateText AS DATE) END AS SessionDate
    FROM submission) s LEFT JOIN users u ON u.UserID = s.UserID
  LEFT JOIN known_sessions k ON k.UserID = s.UserID AND k.SessionDate = s.SessionDate
  LEFT JOIN findings f ON f.SubmissionID = s.SubmissionID""",
)
PARTS["judged"] = (
    ("checked",),
    """SELECT c.*, CASE WHEN c.FastingStatus IS NULL OR c.SessionDateText = '' THEN 'invalid_value'
    WHEN c.SessionDate IS NULL THEN 'invalid_date' WHEN NOT c.UserKnown THEN 'unknown_user'
    WHEN c.Stored OR w.Winner < c.SubmissionID THEN 'duplicate_session' WHEN c.Unknown THEN 'unknown_biomarker'
    WHEN c.NoValue THEN 'null_value' WHEN c.Repeated THEN 'repeated_biomarker' END AS Reason
  FROM checked c LEFT JOIN (SELECT UserID, SessionDate, MIN(SubmissionID) AS Winner FROM checked
    WHERE FastingStatus IS NOT NULL AND SessionDate IS NOT NULL AND UserKnown AND NOT Stored AND NOT Unknown
    AND NOT NoValue AND NOT Repeated GROUP BY UserID, SessionDate) w
  ON w.UserID = c.UserID AND w.SessionDate = c.SessionDate""",
)
PARTS["accepted"] = (
    ("judged", "known_sessions"),
    """SELECT SubmissionID, CAST((SELECT MAX(SessionID) FROM known_sessions) + row_number() OVER (ORDER BY SubmissionID)
  AS INT) AS SessionID, UserID, SessionDate, FastingStatus FROM judged WHERE Reason IS NULL""",
)
MATERIALIZED |= {"checked", "judged", "accepted"}

_MEASURED = """SELECT a.SubmissionID, a.SessionID, v.BiomarkerID, v.Value,
  CAST(a.SessionDate AS TIMESTAMP) + INTERVAL 510 MINUTE AS TakenAt
  FROM accepted a JOIN submitted_value v ON v.SubmissionID = a.SubmissionID"""


def _ingested(spark, sf) -> Ingested:
    t = survey_tables(spark, sf)
    return ingest(
        derive(spark, sf, "submission"),
        derive(spark, sf, "submitted_value"),
        t.users,
        t.sessions.where(F.col("SessionDate") < KNOWN_UNTIL),
        t.biomarkers,
        INGESTED_AT,
    )


@query("q04_ingest", ["accepted", "submitted_value"], _MEASURED)
def _(spark, sf):
    return _ingested(spark, sf).measurements


@query("q04_ingest_sessions", ["accepted"], "SELECT * FROM accepted")
def _(spark, sf):
    return _ingested(spark, sf).sessions


@query(
    "q04_ingest_rejected",
    ["judged"],
    "SELECT SubmissionID, UserID, SessionDateText, FastingStatus, Reason FROM judged WHERE Reason IS NOT NULL",
)
def _(spark, sf):
    return _ingested(spark, sf).rejected


@query(
    "q04_ingest_replies",
    ["accepted", "submitted_value", "known_sessions", "measurements"],
    f"""SELECT SubmissionID, SessionID AS sessionId, COUNT(n) AS Stored,
  coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') AS measurementIds
FROM accepted LEFT JOIN (SELECT m.SubmissionID, row_number() OVER (ORDER BY m.SessionID, m.BiomarkerID)
  + (SELECT COUNT(*) FROM measurements k SEMI JOIN known_sessions USING (SessionID)) AS n
  FROM ({_MEASURED}) m) v USING (SubmissionID) GROUP BY SubmissionID, SessionID""",
)
def _(spark, sf):
    """What submitters get back: the visit, and the ids of its values behind those stored."""
    t = survey_tables(spark, sf)
    known = t.measured().where(F.col("SessionDate") < KNOWN_UNTIL)
    stored = as_record(known, "measurements", STORED_AT["measurements"])
    found = replies(_ingested(spark, sf), stored, INGESTED_AT)
    ids = F.col("measurementIds")
    return found.select("SubmissionID", "sessionId", F.size(ids).cast("long").alias("Stored"), F.array_join(ids, ",").alias("measurementIds"))


@query("q04_ingest_stream", ["accepted", "submitted_value"], _MEASURED)
def _(spark, sf):
    t = survey_tables(spark, sf)
    source, target = scratch(spark, "submissions"), scratch(spark, "ingested")
    headers, values = derive(spark, sf, "submission"), derive(spark, sf, "submitted_value")
    listed = values.groupBy("SubmissionID").agg(
        F.collect_list(F.struct(F.col("BiomarkerID").alias("biomarkerId"), F.col("Value").alias("value"))).alias("measurements")
    )
    bodies = headers.join(listed, "SubmissionID", "left").select(
        "SubmissionID",
        "UserID",
        F.col("SessionDateText").alias("sessionDate"),
        F.col("FastingStatus").alias("fastingStatus"),
        F.coalesce("measurements", F.expr("CAST(array() AS ARRAY<STRUCT<biomarkerId: INT, value: DECIMAL(12,4)>>)")).alias("measurements"),
    )
    bodies.write.json(source, ignoreNullFields=False)
    stream = ingest_stream(
        spark,
        source,
        target,
        t.users,
        t.sessions.where(F.col("SessionDate") < KNOWN_UNTIL),
        t.biomarkers,
        checkpoint=scratch(spark, "ingest-checkpoint"),
        ingested_at=INGESTED_AT,
        partitions=8,
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{target}/measurements").drop("batch")
