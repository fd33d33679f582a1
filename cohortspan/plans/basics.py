"""Registered plain operators, each on the whole measurement or visit table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.operators import relational as rel
from cohortspan.plans.define import PARTS, query
from cohortspan.sources.star import derive, survey_tables

PARTS["visits"] = (
    ("measurements", "sessions"),
    """SELECT m.SessionID, m.BiomarkerID, m.Value, m.TakenAt, s.UserID, s.SessionDate, s.FastingStatus
  FROM measurements m JOIN sessions s ON s.SessionID = m.SessionID""",
)


@query(
    "op_count_distinct",
    ["visits"],
    """SELECT BiomarkerID, COUNT(DISTINCT UserID) AS distinct_UserID, COUNT(DISTINCT SessionDate) AS distinct_SessionDate
  FROM visits GROUP BY BiomarkerID""",
)
def _(spark, sf):
    visits = rel.measured_visits(survey_tables(spark, sf))
    return rel.count_distinct(visits, ["BiomarkerID"], "UserID", "SessionDate")


@query(
    "op_conditional_sum",
    ["visits"],
    """SELECT BiomarkerID, CAST(SUM(CASE WHEN FastingStatus THEN 1 ELSE 0 END) AS BIGINT) AS fasting,
  CAST(SUM(CASE WHEN Value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM visits GROUP BY BiomarkerID""",
)
def _(spark, sf):
    visits = rel.measured_visits(survey_tables(spark, sf))
    return rel.conditional_sum(visits, ["BiomarkerID"], fasting=F.col("FastingStatus"), high=F.col("Value") > 10)


@query(
    "op_minmax_stats",
    ["measurements"],
    """SELECT BiomarkerID, COUNT(Value) AS n, MIN(Value) AS lowest, MAX(Value) AS highest FROM measurements
  GROUP BY BiomarkerID""",
)
def _(spark, sf):
    return rel.minmax_stats(survey_tables(spark, sf).measurements, ["BiomarkerID"], "Value")


@query(
    "op_pivot_max_case",
    ["measurements"],
    "SELECT SessionID, "
    + ", ".join(f"MAX(CASE WHEN BiomarkerID = {i} THEN Value END) AS b{i}" for i in range(1, 10))
    + " FROM measurements GROUP BY SessionID",
)
def _(spark, sf):
    measurements = survey_tables(spark, sf).measurements
    return rel.pivot_max(measurements, ["SessionID"], "BiomarkerID", "Value", {f"b{i}": i for i in range(1, 10)})


@query(
    "op_unpivot",
    ["raw_biopro"],
    " UNION ALL ".join(
        f"SELECT SEQN, '{c}' AS NHANESVarCode, {c} AS Value FROM raw_biopro WHERE {c} IS NOT NULL"
        for c in ("LBXSAL", "LBXSAPSI", "LBXSCR")
    ),
)
def _(spark, sf):
    return rel.unpivot(derive(spark, sf, "raw_biopro"), "SEQN", "NHANESVarCode", "Value")


@query(
    "op_union_all",
    ["sessions", "anthropometry"],
    "SELECT UserID, SessionDate AS Date FROM sessions UNION ALL SELECT UserID, ExamDate FROM anthropometry",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return rel.union_all(
        t.sessions.select("UserID", F.col("SessionDate").alias("Date")),
        t.anthropometry.select("UserID", F.col("ExamDate").alias("Date")),
    )


@query(
    "op_dedupe_first",
    ["sessions"],
    """SELECT UserID, SessionID, SessionDate FROM (SELECT *, row_number() OVER (PARTITION BY UserID
  ORDER BY SessionDate, SessionID) AS n FROM sessions) x WHERE n = 1""",
)
def _(spark, sf):
    sessions = survey_tables(spark, sf).sessions.select("UserID", "SessionID", "SessionDate")
    return rel.dedupe_first(sessions, ["UserID"], [F.col("SessionDate"), F.col("SessionID")])


@query(
    "op_topk_per_group",
    ["measurements"],
    """SELECT SessionID, BiomarkerID, Value, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY BiomarkerID
  ORDER BY Value DESC, SessionID) AS INT) AS position FROM measurements) x WHERE position <= 5""",
)
def _(spark, sf):
    measurements = survey_tables(spark, sf).measurements.select("SessionID", "BiomarkerID", "Value")
    return rel.topk_per_group(measurements, ["BiomarkerID"], [F.col("Value").desc(), F.col("SessionID")], 5)


@query(
    "op_semi_join",
    ["sessions", "measurements"],
    """SELECT SessionID, UserID FROM sessions s WHERE EXISTS
  (SELECT 1 FROM measurements m WHERE m.SessionID = s.SessionID AND m.Value > 100)""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return rel.having_match(t.sessions.select("SessionID", "UserID"), t.measurements.where("Value > 100"), ["SessionID"])


@query(
    "op_anti_join",
    ["sessions", "measurements"],
    """SELECT SessionID, UserID FROM sessions s WHERE NOT EXISTS
  (SELECT 1 FROM measurements m WHERE m.SessionID = s.SessionID AND m.Value > 100)""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return rel.without_match(
        t.sessions.select("SessionID", "UserID"), t.measurements.where("Value > 100"), ["SessionID"]
    )
