"""Registered scans, files, cleaning steps, loads, upserts and deletes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan import catalog, tables
from cohortspan.operators import buckets, etl, quality, records, survey, upsert
from cohortspan.plans.api import _USAGE
from cohortspan.plans.define import PARTS, query
from cohortspan.schemas import RECORD_IDS
from cohortspan.session import cut_lineage, scratch
from cohortspan.sources import csvfiles, xpt
from cohortspan.sources.samples import write_xpt
from cohortspan.sources.star import FOUNDED, RAW, STORED_AT, derive, survey_tables

# ---- scans, files, catalogs -------------------------------------------------------------------

# A column per table whose sum shows that the rows came back unchanged.
_SUMMED = {
    "users": "SEQN",
    "sessions": "SessionID",
    "biomarkers": "BiomarkerID",
    "measurements": "Value",
    "anthropometry": "WeightKG",
    "ranges": "MaxVal",
    "models": "ModelID",
    "coefficients": "Coefficient",
    "results": "BioAgeYears",
}


# What names a row of each table: its id, or the first part of its key.
_NAMED = {"users": "UserID", "sessions": "SessionID", "biomarkers": "BiomarkerID", "models": "ModelID", "coefficients": "ModelID", **RECORD_IDS}


@query(
    "scan_tables",
    [f"{name}_records" for name in _SUMMED],
    " UNION ALL ".join(
        f"""SELECT '{name}' AS TableName, COUNT(*) AS RowCount, CAST(SUM({c}) AS DECIMAL(38,6)) AS Total,
  CAST(SUM(CAST({_NAMED[name]} AS DECIMAL(18,0)) * CAST({c} AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS NamedTotal,
  MIN(CreatedAt) AS Oldest, MAX(CreatedAt) AS Newest FROM {name}_records"""
        for name, c in _SUMMED.items()
    ),
)
def _(spark, sf):
    """The full data model, written and read back. ``NamedTotal`` changes if an id comes to another row."""
    folder = scratch(spark, "tables")
    tables.write_tables(records.as_records(survey_tables(spark, sf), STORED_AT, FOUNDED), folder)
    parts = [
        df.agg(
            F.lit(name).alias("TableName"),
            F.count(F.lit(1)).alias("RowCount"),
            F.sum(_SUMMED[name]).cast("decimal(38,6)").alias("Total"),
            F.sum(F.col(_NAMED[name]).cast("decimal(18,0)") * F.col(_SUMMED[name]).cast("decimal(18,6)"))
            .cast("decimal(38,6)")
            .alias("NamedTotal"),
            F.min("CreatedAt").alias("Oldest"),
            F.max("CreatedAt").alias("Newest"),
        )
        for name, df in tables.scan_tables(spark, folder, records=True).items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("read_xpt", ["raw_bmx"], "SELECT SEQN, BMXBMI, BMXHT FROM raw_bmx")
def _(spark, sf):
    folder = scratch(spark, "xpt")
    write_xpt(derive(spark, sf, "raw_bmx"), folder)
    return xpt.read_xpt(spark, folder, ["BMXBMI", "BMXHT"], rows_per_partition=5_000)


_STAGED_CSV = "SELECT UserID AS SEQN, SessionDateText, CAST(FastingStatus AS INT) AS FastingStatus FROM submission"


def _staged_visits(spark, sf) -> tuple[DataFrame, DataFrame]:
    folder = scratch(spark, "visits-csv")
    staged = derive(spark, sf, "submission").select(
        F.col("UserID").alias("SEQN"), "SessionDateText", F.col("FastingStatus").cast("int")
    )
    csvfiles.write_csv(staged, folder)
    return csvfiles.read_csv(spark, folder, csvfiles.SESSIONS_CSV)


@query(
    "load_csv_schema",
    ["submission"],
    f"""SELECT SEQN, CAST(SessionDateText AS DATE) AS SessionDate, FastingStatus FROM ({_STAGED_CSV}) s
  WHERE SessionDateText <> 'not-a-date'""",
)
def _(spark, sf):
    return _staged_visits(spark, sf)[0]


@query(
    "load_csv_rejected",
    ["submission"],
    f"""SELECT concat(CAST(SEQN AS VARCHAR), ',', SessionDateText, ',', coalesce(CAST(FastingStatus AS VARCHAR), ''))
  AS Line FROM ({_STAGED_CSV}) s WHERE SessionDateText = 'not-a-date'""",
)
def _(spark, sf):
    return _staged_visits(spark, sf)[1]


@query("load_csv_ranges", ["ranges_etl", "measurements"], _USAGE.format(ranges="ranges_etl"))
def _(spark, sf):
    path = scratch(spark, "ranges-csv")
    csvfiles.write_ranges(catalog.ranges(spark, "etl"), path)
    return quality.range_usage(survey_tables(spark, sf).replace(ranges=csvfiles.read_ranges(spark, path)))


@query("replace_ranges", ["ranges_etl", "measurements"], _USAGE.format(ranges="ranges_etl"))
def _(spark, sf):
    folder = scratch(spark, "ranges")
    csvfiles.replace_ranges(catalog.ranges(spark, "seed"), folder)
    replaced = csvfiles.replace_ranges(catalog.ranges(spark, "etl"), folder)
    return quality.range_usage(survey_tables(spark, sf).replace(ranges=replaced))


@query(
    "seed_biomarkers",
    ["biomarkers", "counted"],
    "SELECT b.*, coalesce(c.MeasurementCount, 0) AS MeasurementCount FROM biomarkers b LEFT JOIN counted c USING (BiomarkerID)",
)
def _(spark, sf):
    return quality.with_measurements(catalog.biomarkers(spark), survey_tables(spark, sf))


@query(
    "seed_models",
    ["models", "results"],
    """SELECT m.*, coalesce(x.n, 0) AS ResultCount FROM models m
  LEFT JOIN (SELECT ModelID, COUNT(*) AS n FROM results GROUP BY ModelID) x ON x.ModelID = m.ModelID""",
)
def _(spark, sf):
    counts = survey_tables(spark, sf).results.groupBy("ModelID").agg(F.count(F.lit(1)).alias("ResultCount"))
    return catalog.models(spark).join(counts, "ModelID", "left").fillna(0, subset=["ResultCount"])


@query(
    "seed_coefficients",
    ["coefficients", "counted"],
    "SELECT c.*, coalesce(n.MeasurementCount, 0) AS MeasurementCount FROM coefficients c LEFT JOIN counted n USING (BiomarkerID)",
)
def _(spark, sf):
    return quality.with_measurements(catalog.coefficients(spark), survey_tables(spark, sf))


@query("seed_ranges", ["ranges", "measurements"], _USAGE.format(ranges="ranges"))
def _(spark, sf):
    return quality.range_usage(survey_tables(spark, sf).replace(ranges=catalog.ranges(spark, "seed")))


# ---- cleaning ---------------------------------------------------------------------------------

_SEX = "CASE d.RIAGENDR WHEN 1 THEN 'M' WHEN 2 THEN 'F' END"
_RACE = (
    "CASE d.RIDRETH3 " + " ".join(f"WHEN {code} THEN '{label}'" for code, label in etl.RACE_CODES.items()) + " END"
)
# Exam windows and their dates.
_EXAM = "CASE d.RIDEXMON WHEN 1 THEN DATE '2018-01-15' WHEN 2 THEN DATE '2018-07-15' ELSE DATE '2018-01-01' END"
PARTS["etl_users"] = (
    ("raw_demo",),
    f"""SELECT CAST(d.SEQN AS INT) AS SEQN, CAST(d.RIDAGEYR AS INT) AS Age, {_SEX} AS Sex, {_RACE} AS RaceEthnicity
  FROM raw_demo d WHERE d.SEQN IS NOT NULL AND d.RIDAGEYR IS NOT NULL AND {_SEX} IS NOT NULL AND {_RACE} IS NOT NULL""",
)
PARTS["etl_exam"] = (("raw_demo",), f"SELECT CAST(d.SEQN AS INT) AS SEQN, {_EXAM} AS ExamDate FROM raw_demo d")
PARTS["etl_fasting"] = (
    ("raw_fastqx",),
    """SELECT CAST(SEQN AS INT) AS SEQN, CASE WHEN coalesce(PHAFSTHR, 0) + coalesce(PHAFSTMN, 0) / 60 >= 8 THEN 1 ELSE 0
  END AS IsFasted FROM raw_fastqx""",
)
PARTS["etl_sessions"] = (
    ("etl_users", "etl_exam", "etl_fasting"),
    """SELECT u.SEQN, e.ExamDate AS SessionDate, coalesce(f.IsFasted, 0) AS FastingStatus FROM etl_users u
  LEFT JOIN etl_exam e ON e.SEQN = u.SEQN LEFT JOIN etl_fasting f ON f.SEQN = u.SEQN""",
)
# Laboratory files and the variables they hold.
_LABS = {
    "raw_biopro": ["LBXSAL", "LBXSAPSI", "LBXSCR"],
    "raw_glu": ["LBXGLU"],
    "raw_hscrp": ["LBXHSCRP"],
    "raw_cbc": ["LBXWBCSI", "LBXLYPCT", "LBXMCVSI", "LBXRDW"],
}
PARTS["etl_long"] = (
    tuple(_LABS),
    " UNION ALL ".join(
        f"SELECT SEQN, '{c}' AS NHANESVarCode, {c} AS Value FROM {lab} WHERE {c} IS NOT NULL"
        for lab, names in _LABS.items()
        for c in names
    ),
)
PARTS["etl_measurements"] = (
    ("etl_long", "etl_exam", "biomarkers"),
    """SELECT CAST(l.SEQN AS INT) AS SEQN, e.ExamDate AS SessionDate, b.BiomarkerID, l.Value, e.ExamDate AS TakenAt
  FROM etl_long l JOIN biomarkers b ON b.NHANESVarCode = l.NHANESVarCode JOIN etl_exam e ON e.SEQN = CAST(l.SEQN AS INT)""",
)
PARTS["etl_anthropometry"] = (
    ("raw_bmx", "etl_exam"),
    """SELECT CAST(x.SEQN AS INT) AS SEQN, e.ExamDate, x.BMXHT AS HeightCM, x.BMXWT AS WeightKG, x.BMXBMI AS BMI
  FROM raw_bmx x JOIN etl_exam e ON e.SEQN = CAST(x.SEQN AS INT)""",
)


def raw(spark, sf) -> dict[str, DataFrame]:
    return {name: derive(spark, sf, name) for name in RAW}


def cleaned(spark, sf) -> dict[str, DataFrame]:
    return etl.survey_etl(raw(spark, sf), catalog.biomarkers(spark))


@query("etl_users", ["etl_users"], "SELECT * FROM etl_users")
def _(spark, sf):
    return etl.clean_users(derive(spark, sf, "raw_demo"))


@query(
    "etl_birthdate",
    ["etl_users"],
    "SELECT SEQN, make_date(2018 - Age, 7, 1) AS BirthDate, Sex, RaceEthnicity FROM etl_users",
)
def _(spark, sf):
    return cleaned(spark, sf)["users"]


@query("etl_exam_date", ["etl_exam"], "SELECT * FROM etl_exam")
def _(spark, sf):
    demo = derive(spark, sf, "raw_demo")
    return etl.with_exam_date(demo.select(F.col("SEQN").cast("int").alias("SEQN")), demo, "ExamDate")


@query("etl_anthropometry", ["etl_anthropometry"], "SELECT * FROM etl_anthropometry")
def _(spark, sf):
    return cleaned(spark, sf)["anthropometry"]


@query("etl_fasting", ["etl_fasting"], "SELECT * FROM etl_fasting")
def _(spark, sf):
    return etl.fasting_status(derive(spark, sf, "raw_fastqx"))


@query("etl_sessions", ["etl_sessions"], "SELECT * FROM etl_sessions")
def _(spark, sf):
    return cleaned(spark, sf)["sessions"]


@query("etl_measurements", ["etl_measurements"], "SELECT * FROM etl_measurements")
def _(spark, sf):
    return cleaned(spark, sf)["measurements"]


@query(
    "write_csv",
    ["etl_measurements"],
    "SELECT SEQN, SessionDate, BiomarkerID, CAST(Value AS DECIMAL(12,4)) AS Value, TakenAt FROM etl_measurements",
)
def _(spark, sf):
    folder = scratch(spark, "measurements-csv")
    csvfiles.write_csv(cleaned(spark, sf)["measurements"], folder)
    return csvfiles.read_csv(spark, folder, csvfiles.MEASUREMENTS_CSV)[0]


# ---- loads ------------------------------------------------------------------------------------

# Part of the visits is stored before the load, so that it has clashes to pass over.
PARTS["load_keyed"] = (
    ("etl_sessions", "users"),
    """SELECT u.UserID, u.Sex, e.SessionDate, e.FastingStatus = 1 AS FastingStatus
  FROM etl_sessions e JOIN users u ON u.SEQN = e.SEQN""",
)
PARTS["load_new"] = (
    ("load_keyed", "sessions"),
    """SELECT CAST((SELECT MAX(SessionID) FROM sessions) + row_number() OVER (ORDER BY UserID) AS INT) AS SessionID,
  UserID, SessionDate, FastingStatus FROM load_keyed""",
)


# Buckets of the stored tables; few, as the tables of the checks are small.
BUCKETS = 8


def _colocated(spark, t: tables.Tables, *names: str) -> tables.Tables:
    prefix = f"load_{uuid.uuid4().hex}"
    chosen = tables.Tables(**{name: getattr(t, name) for name in names})
    return tables.write_colocated(chosen, scratch(spark, "colocated"), prefix, BUCKETS)


def _loaded_sessions(spark, sf, t) -> DataFrame:
    new = etl.load_sessions(cleaned(spark, sf)["sessions"], t.users, t.sessions)
    highest = t.sessions.agg(F.max("SessionID")).first()[0]
    return etl.assign_ids(new, "SessionID", ["UserID"], highest + 1).withColumn("SessionID", F.col("SessionID").cast("int"))


@query(
    "load_users",
    ["users", "etl_users"],
    """, known AS (SELECT * FROM users WHERE BirthDate < DATE '1975-01-01')
SELECT CAST((SELECT MAX(UserID) FROM known) + row_number() OVER (ORDER BY SEQN) AS INT) AS UserID, SEQN,
  make_date(2018 - Age, 7, 1) AS BirthDate, Sex, RaceEthnicity FROM etl_users WHERE SEQN NOT IN (SELECT SEQN FROM known)""",
)
def _(spark, sf):
    known = survey_tables(spark, sf).users.where("BirthDate < DATE '1975-01-01'")
    return etl.load_users(cleaned(spark, sf)["users"], known)


@query(
    "load_sessions", ["load_keyed"], "SELECT UserID, SessionDate, FastingStatus FROM load_keyed WHERE Sex <> 'M'"
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    staged = cut_lineage(cleaned(spark, sf)["sessions"], "staged-sessions")
    men = t.users.where("Sex = 'M'")
    added = etl.load_sessions(staged, men, t.sessions).withColumn("SessionID", F.lit(0))
    stored = _colocated(spark, t.replace(sessions=t.sessions.unionByName(added)), "users", "sessions")
    return etl.load_sessions(staged, stored.users, stored.sessions, BUCKETS)


@query(
    "load_measurements",
    ["load_new", "etl_measurements", "users"],
    """SELECT s.SessionID, m.BiomarkerID, CAST(m.Value AS DECIMAL(12,4)) AS Value, CAST(m.TakenAt AS TIMESTAMP) AS TakenAt
  FROM etl_measurements m JOIN users u ON u.SEQN = m.SEQN
  JOIN load_new s ON s.UserID = u.UserID AND s.SessionDate = m.SessionDate""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    staged = cut_lineage(cleaned(spark, sf)["measurements"], "staged-measurements")
    values = t.measured().select("SessionID", "BiomarkerID", "Value", "TakenAt", "UserID", "SessionDate")
    stored = _colocated(spark, t.replace(sessions=_loaded_sessions(spark, sf, t), measurements=values), "users", "sessions", "measurements")
    return etl.load_measurements(staged, stored.users, stored.sessions, stored.measurements, BUCKETS)


@query(
    "load_anthropometry",
    ["etl_anthropometry", "users"],
    """SELECT u.UserID, a.ExamDate, CAST(a.HeightCM AS DECIMAL(5,2)) AS HeightCM, CAST(a.WeightKG AS DECIMAL(5,2)) AS WeightKG,
  CAST(a.BMI AS DECIMAL(4,2)) AS BMI FROM etl_anthropometry a JOIN users u ON u.SEQN = a.SEQN""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return etl.load_anthropometry(cleaned(spark, sf)["anthropometry"], t.users, t.anthropometry)


# Loads with something to reject: later-born users are not stored yet, visits without fasting neither, and some
# numbers come in a unit that makes them too large for their columns.
PARTS["early_users"] = (("users",), "SELECT * FROM users WHERE BirthDate < DATE '1975-01-01'")


@query(
    "load_measurements_rejected",
    ["early_users", "load_keyed", "etl_measurements"],
    """, scaled AS (SELECT SEQN, SessionDate, BiomarkerID, CASE WHEN BiomarkerID = 9 THEN Value * 10000000 ELSE Value END AS Value,
    TakenAt FROM etl_measurements)
SELECT * FROM (SELECT m.*, CASE WHEN u.UserID IS NULL THEN 'unknown_participant' WHEN v.UserID IS NULL THEN 'no_such_visit'
    WHEN m.Value >= 100000000 THEN 'value_does_not_fit' END AS Reason FROM scaled m LEFT JOIN early_users u ON u.SEQN = m.SEQN
  LEFT JOIN (SELECT UserID, SessionDate FROM load_keyed WHERE FastingStatus) v
    ON v.UserID = u.UserID AND v.SessionDate = m.SessionDate) x WHERE Reason IS NOT NULL""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    files = cleaned(spark, sf)
    known = t.users.where("BirthDate < DATE '1975-01-01'")
    visits = etl.load_sessions(files["sessions"], t.users, t.sessions).where("FastingStatus")
    scaled = F.when(F.col("BiomarkerID") == 9, F.col("Value") * 10_000_000).otherwise(F.col("Value"))
    return etl.rejected_measurements(files["measurements"].withColumn("Value", scaled), known, visits)


@query(
    "load_anthropometry_rejected",
    ["early_users", "etl_anthropometry"],
    """, scaled AS (SELECT SEQN, ExamDate, CASE WHEN WeightKG >= 60 THEN HeightCM * 10 ELSE HeightCM END AS HeightCM, WeightKG, BMI
    FROM etl_anthropometry)
SELECT * FROM (SELECT a.*, CASE WHEN u.UserID IS NULL THEN 'unknown_participant' WHEN a.HeightCM >= 1000
    THEN 'measure_does_not_fit' END AS Reason FROM scaled a LEFT JOIN early_users u ON u.SEQN = a.SEQN) x
  WHERE Reason IS NOT NULL""",
)
def _(spark, sf):
    known = survey_tables(spark, sf).users.where("BirthDate < DATE '1975-01-01'")
    scaled = F.when(F.col("WeightKG") >= 60, F.col("HeightCM") * 10).otherwise(F.col("HeightCM"))
    return etl.rejected_anthropometry(cleaned(spark, sf)["anthropometry"].withColumn("HeightCM", scaled), known)


# A whole cycle at once, from transport files. Stored is what belongs to the users born early.
PARTS["cycle_users"] = (
    ("early_users", "etl_users"),
    """SELECT UserID, SEQN, FALSE AS IsNew FROM early_users UNION ALL SELECT CAST((SELECT MAX(UserID) FROM early_users)
  + row_number() OVER (ORDER BY SEQN) AS INT), SEQN, TRUE FROM etl_users WHERE SEQN NOT IN (SELECT SEQN FROM early_users)""",
)
PARTS["cycle_sessions"] = (
    ("cycle_users", "etl_sessions", "early_users", "sessions"),
    """SELECT (SELECT MAX(SessionID) FROM sessions SEMI JOIN early_users USING (UserID))
  + row_number() OVER (ORDER BY u.UserID, e.SessionDate) AS SessionID, u.UserID, e.SEQN, e.SessionDate
  FROM etl_sessions e JOIN cycle_users u ON u.SEQN = e.SEQN""",
)


@query(
    "load_survey",
    ["cycle_users", "cycle_sessions", "etl_measurements", "etl_anthropometry"],
    """, placed AS (SELECT m.*, s.SessionID FROM etl_measurements m LEFT JOIN cycle_sessions s
  ON s.SEQN = m.SEQN AND s.SessionDate = m.SessionDate)
SELECT 'users' AS TableName, CAST(UserID AS BIGINT) AS KeyA, CAST(SEQN AS BIGINT) AS KeyB, CAST(NULL AS DECIMAL(12,4)) AS Value
  FROM cycle_users WHERE IsNew
UNION ALL SELECT 'sessions', SessionID, UserID, NULL FROM cycle_sessions
UNION ALL SELECT 'measurements', SessionID, BiomarkerID, CAST(Value AS DECIMAL(12,4)) FROM placed WHERE SessionID IS NOT NULL
UNION ALL SELECT 'anthropometry', u.UserID, a.SEQN, CAST(a.BMI AS DECIMAL(12,4)) FROM etl_anthropometry a
  JOIN cycle_users u ON u.SEQN = a.SEQN
UNION ALL SELECT 'rejected_measurements', SEQN, BiomarkerID, CAST(Value AS DECIMAL(12,4)) FROM placed WHERE SessionID IS NULL
UNION ALL SELECT 'rejected_anthropometry', SEQN, NULL, CAST(BMI AS DECIMAL(12,4)) FROM etl_anthropometry
  WHERE SEQN NOT IN (SELECT SEQN FROM cycle_users)""",
)
def _(spark, sf):
    """Rows that the tables gain, by their keys, and those that could not be placed."""
    t = survey_tables(spark, sf)
    early = t.users.where("BirthDate < DATE '1975-01-01'")
    theirs = t.sessions.join(early.select("UserID"), "UserID", "left_semi").select(*t.sessions.columns)
    values = t.measurements.join(theirs.select("SessionID"), "SessionID", "left_semi")
    body = t.anthropometry.join(early.select("UserID"), "UserID", "left_semi").select(*t.anthropometry.columns)
    stored = t.replace(users=early, sessions=theirs, measurements=values, anthropometry=body)

    paths = {name: scratch(spark, name) for name in survey.FILES}
    for name, path in paths.items():
        write_xpt(derive(spark, sf, name), path)
    done = survey.load_survey(survey.read_survey(spark, paths), stored)
    users = stored.users.unionByName(done.added.users).select("UserID", "SEQN")
    parts = {
        "users": (done.added.users, "UserID", "SEQN", F.lit(None)),
        "sessions": (done.added.sessions, "SessionID", "UserID", F.lit(None)),
        "measurements": (done.added.measurements, "SessionID", "BiomarkerID", F.col("Value")),
        "anthropometry": (done.added.anthropometry.join(users, "UserID"), "UserID", "SEQN", F.col("BMI")),
        "rejected_measurements": (done.rejected_measurements, "SEQN", "BiomarkerID", F.col("Value")),
        "rejected_anthropometry": (done.rejected_anthropometry.withColumn("None", F.lit(None)), "SEQN", "None", F.col("BMI")),
    }
    found = [
        df.select(F.lit(name).alias("TableName"), F.col(a).cast("long").alias("KeyA"), F.col(b).cast("long").alias("KeyB"), v.cast("decimal(12,4)").alias("Value"))
        for name, (df, a, b, v) in parts.items()
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "surrogate_keys",
    ["sessions"],
    "SELECT UserID, SessionDate, row_number() OVER (ORDER BY UserID, SessionDate) AS NewID FROM sessions",
)
def _(spark, sf):
    sessions = survey_tables(spark, sf).sessions.select("UserID", "SessionDate")
    return etl.assign_ids(sessions, "NewID", ["UserID", "SessionDate"])


# ---- upserts and deletes ----------------------------------------------------------------------

# What is stored before, and what arrives: the periods overlap, so rows are kept, changed and added.
STORED_UNTIL, ARRIVING_FROM = "2000-01-01", "1999-01-01"


def _upserted(spark, name: str, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The whole table after ``incoming`` was brought into the buckets of ``stored`` that it touches."""
    table = buckets.create_named(spark, name, stored, BUCKETS)
    return buckets.upsert_named(table, name, incoming).read()


# Users born before this year are stored; the others arrive, unless the cleaned files bring them.
PARTS["arriving_users"] = (
    ("users", "etl_users"),
    """SELECT SEQN, make_date(2018 - Age, 7, 1) AS BirthDate, Sex, RaceEthnicity FROM etl_users
  UNION ALL SELECT u.SEQN, u.BirthDate, u.Sex, u.RaceEthnicity FROM users u LEFT JOIN etl_users e ON e.SEQN = u.SEQN
  WHERE u.BirthDate >= DATE '1975-01-01' AND e.SEQN IS NULL""",
)


@query(
    "upsert_users",
    ["users", "arriving_users"],
    """SELECT coalesce(UserID, CAST(mx + row_number() OVER (PARTITION BY UserID IS NULL ORDER BY SEQN) AS INT)) AS UserID,
  SEQN, BirthDate, Sex, RaceEthnicity FROM (SELECT e.UserID, coalesce(e.SEQN, i.SEQN) AS SEQN,
    CASE WHEN i.SEQN IS NOT NULL THEN i.BirthDate ELSE e.BirthDate END AS BirthDate,
    CASE WHEN i.SEQN IS NOT NULL THEN i.Sex ELSE e.Sex END AS Sex,
    CASE WHEN i.SEQN IS NOT NULL THEN i.RaceEthnicity ELSE e.RaceEthnicity END AS RaceEthnicity,
    (SELECT MAX(UserID) FROM users WHERE BirthDate < DATE '1975-01-01') AS mx
    FROM (SELECT * FROM users WHERE BirthDate < DATE '1975-01-01') e FULL OUTER JOIN arriving_users i ON e.SEQN = i.SEQN) x""",
)
def _(spark, sf):
    users = survey_tables(spark, sf).users
    stored = users.where("BirthDate < DATE '1975-01-01'")
    files = cleaned(spark, sf)["users"]
    held_back = users.where("BirthDate >= DATE '1975-01-01'").join(files.select("SEQN"), "SEQN", "left_anti")
    incoming = files.unionByName(held_back.select(*files.columns))
    return _upserted(spark, "users", stored, incoming)


@query(
    "upsert_sessions",
    ["sessions"],
    f"""SELECT coalesce(SessionID, CAST(mx + row_number() OVER (PARTITION BY SessionID IS NULL ORDER BY UserID, SessionDate)
  AS INT)) AS SessionID, UserID, SessionDate, FastingStatus FROM (SELECT e.SessionID, coalesce(e.UserID, i.UserID) AS UserID,
    coalesce(e.SessionDate, i.SessionDate) AS SessionDate,
    CASE WHEN i.UserID IS NOT NULL THEN NOT i.FastingStatus ELSE e.FastingStatus END AS FastingStatus,
    (SELECT MAX(SessionID) FROM sessions WHERE SessionDate < DATE '{STORED_UNTIL}') AS mx
    FROM (SELECT * FROM sessions WHERE SessionDate < DATE '{STORED_UNTIL}') e
    FULL OUTER JOIN (SELECT * FROM sessions WHERE SessionDate >= DATE '{ARRIVING_FROM}') i
    ON e.UserID = i.UserID AND e.SessionDate = i.SessionDate) x""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    stored = t.sessions.where(F.col("SessionDate") < STORED_UNTIL)
    incoming = (
        t.sessions.where(F.col("SessionDate") >= ARRIVING_FROM)
        .join(t.users.select("UserID", "SEQN"), "UserID")
        .select("SEQN", "SessionDate", (~F.col("FastingStatus")).alias("FastingStatus"))
    )
    return _upserted(spark, "sessions", stored, upsert.user_ids(incoming, t.users))


@query(
    "upsert_anthropometry",
    ["anthropometry", "etl_anthropometry", "users"],
    """, incoming AS (SELECT u.UserID, a.ExamDate, CAST(a.HeightCM AS DECIMAL(5,2)) AS HeightCM,
    CAST(a.WeightKG AS DECIMAL(5,2)) AS WeightKG, CAST(a.BMI AS DECIMAL(4,2)) AS BMI
    FROM etl_anthropometry a JOIN users u ON u.SEQN = a.SEQN
  UNION ALL SELECT UserID, ExamDate, HeightCM, CAST(WeightKG + 1 AS DECIMAL(5,2)), NULL FROM anthropometry WHERE WeightKG >= 60)
SELECT coalesce(e.UserID, i.UserID) AS UserID, coalesce(e.ExamDate, i.ExamDate) AS ExamDate,
  CASE WHEN i.UserID IS NOT NULL THEN i.HeightCM ELSE e.HeightCM END AS HeightCM,
  CASE WHEN i.UserID IS NOT NULL THEN i.WeightKG ELSE e.WeightKG END AS WeightKG,
  CASE WHEN i.UserID IS NOT NULL THEN i.BMI ELSE e.BMI END AS BMI
  FROM anthropometry e FULL OUTER JOIN incoming i ON e.UserID = i.UserID AND e.ExamDate = i.ExamDate""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    corrected = (
        t.anthropometry.where("WeightKG >= 60")
        .join(t.users.select("UserID", "SEQN"), "UserID")
        .select("SEQN", "ExamDate", "HeightCM", (F.col("WeightKG") + 1).alias("WeightKG"), F.lit(None).cast("decimal(4,2)").alias("BMI"))
    )
    incoming = cleaned(spark, sf)["anthropometry"].unionByName(corrected)
    return _upserted(spark, "anthropometry", t.anthropometry, upsert.user_ids(incoming, t.users))


@query(
    "upsert_measurements",
    ["measurements"],
    f"""SELECT coalesce(e.SessionID, i.SessionID) AS SessionID, coalesce(e.BiomarkerID, i.BiomarkerID) AS BiomarkerID,
  CASE WHEN i.SessionID IS NOT NULL THEN CAST(i.Value + 1 AS DECIMAL(12,4)) ELSE e.Value END AS Value,
  coalesce(e.TakenAt, i.TakenAt + INTERVAL 9 HOUR) AS TakenAt
  FROM (SELECT * FROM measurements WHERE TakenAt < DATE '{STORED_UNTIL}') e
  FULL OUTER JOIN (SELECT * FROM measurements WHERE TakenAt >= DATE '{ARRIVING_FROM}') i
  ON e.SessionID = i.SessionID AND e.BiomarkerID = i.BiomarkerID""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    stored = t.measurements.where(F.col("TakenAt") < STORED_UNTIL)
    incoming = (
        t.measurements.where(F.col("TakenAt") >= ARRIVING_FROM)
        .join(t.sessions.select("SessionID", "UserID", "SessionDate"), "SessionID")
        .join(t.users.select("UserID", "SEQN"), "UserID")
        .select(
            "SEQN",
            "SessionDate",
            "BiomarkerID",
            (F.col("Value") + 1).alias("Value"),
            (F.col("TakenAt") + F.expr("INTERVAL 9 HOURS")).alias("TakenAt"),
        )
    )
    return _upserted(spark, "measurements", stored, upsert.visit_ids(incoming, t.users, t.sessions))


@query(
    "upsert_results",
    ["results"],
    f"""SELECT coalesce(e.UserID, i.UserID) AS UserID, coalesce(e.ModelID, i.ModelID) AS ModelID,
  CASE WHEN i.UserID IS NOT NULL THEN CAST(i.BioAgeYears + 1 AS DECIMAL(5,2)) ELSE e.BioAgeYears END AS BioAgeYears,
  coalesce(e.ComputedAt, i.ComputedAt) AS ComputedAt
  FROM (SELECT * FROM results WHERE ComputedAt < DATE '{STORED_UNTIL}') e
  FULL OUTER JOIN (SELECT * FROM results WHERE ComputedAt >= DATE '{ARRIVING_FROM}') i
  ON e.UserID = i.UserID AND e.ModelID = i.ModelID AND e.ComputedAt = i.ComputedAt""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    stored = t.results.where(F.col("ComputedAt") < STORED_UNTIL)
    incoming = (
        t.results.where(F.col("ComputedAt") >= ARRIVING_FROM)
        .join(t.users.select("UserID", "SEQN"), "UserID")
        .select("SEQN", "ModelID", "ComputedAt", (F.col("BioAgeYears") + 1).alias("BioAgeYears"))
    )
    return _upserted(spark, "results", stored, upsert.user_ids(incoming, t.users))


@query(
    "insert_ignore",
    ["sessions"],
    f"""SELECT UserID, SessionDate, FastingStatus FROM sessions WHERE SessionDate < DATE '{STORED_UNTIL}'
  UNION ALL SELECT UserID, SessionDate, NOT FastingStatus FROM sessions WHERE SessionDate >= DATE '{STORED_UNTIL}'""",
)
def _(spark, sf):
    sessions = survey_tables(spark, sf).sessions.select("UserID", "SessionDate", "FastingStatus")
    stored = sessions.where(F.col("SessionDate") < STORED_UNTIL)
    incoming = sessions.where(F.col("SessionDate") >= ARRIVING_FROM).withColumn("FastingStatus", ~F.col("FastingStatus"))
    added = etl.insert_ignore(stored, incoming, ["UserID", "SessionDate"], [F.col("FastingStatus")])
    return stored.unionByName(added)


_KEPT = {
    "users": ("UserID", "SEQN"),
    "sessions": ("UserID", "SessionID"),
    "measurements": ("SessionID", "BiomarkerID"),
    "anthropometry": ("UserID", "UserID"),
    "results": ("UserID", "ModelID"),
}


def _keys_of(t: tables.Tables, names: list[str]) -> DataFrame:
    result = None
    for name in names:
        first, second = _KEPT[name]
        part = getattr(t, name).select(
            F.lit(name).alias("TableName"), F.col(first).alias("KeyA"), F.col(second).alias("KeyB")
        )
        result = part if result is None else result.unionByName(part)
    return result


def _keys_sql(names: list[str], conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS TableName, {_KEPT[name][0]} AS KeyA, {_KEPT[name][1]} AS KeyB FROM {name} WHERE {conditions[name]}"
        for name in names
    )


_GONE = "UserID NOT IN (SELECT UserID FROM users WHERE BirthDate < DATE '1950-01-01')"


@query(
    "purge_users",
    list(_KEPT),
    _keys_sql(
        list(_KEPT),
        {
            **{name: _GONE for name in _KEPT},
            "measurements": f"SessionID IN (SELECT SessionID FROM sessions WHERE {_GONE})",
        },
    ),
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return _keys_of(upsert.purge_users(t, t.users.where("BirthDate < DATE '1950-01-01'")), list(_KEPT))


_NEWEST = "UserID IN (SELECT UserID FROM users_records ORDER BY CreatedAt DESC, UserID DESC LIMIT 10)"


@query(
    "sample_subset",
    ["users", "users_records", "sessions", "measurements"],
    _keys_sql(
        ["users", "sessions", "measurements"],
        {
            "users": _NEWEST,
            "sessions": _NEWEST,
            "measurements": f"SessionID IN (SELECT SessionID FROM sessions WHERE {_NEWEST})",
        },
    ),
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    t = t.replace(users=records.as_record(t.users, "users", STORED_AT["users"]))
    return _keys_of(upsert.sample_subset(t), ["users", "sessions", "measurements"])


@query(
    "delete_biomarkers",
    ["biomarkers", "counted"],
    "SELECT b.*, coalesce(c.MeasurementCount, 0) AS MeasurementCount FROM biomarkers b LEFT JOIN counted c USING (BiomarkerID)",
)
def _(spark, sf):
    """A biomarker that nothing refers to goes; those with measurements, ranges or coefficients may not."""
    t = survey_tables(spark, sf)
    unused = spark.createDataFrame([(77, "Unused", "LBX77", "mg/dL", "")], t.biomarkers.schema)
    wider = t.replace(biomarkers=t.biomarkers.unionByName(unused))
    left = upsert.delete_biomarkers(wider, unused.select("BiomarkerID"))
    return quality.with_measurements(left.biomarkers, t)


@query(
    "delete_models",
    ["models", "coefficients", "results"],
    """SELECT m.ModelID, m.ModelName, (SELECT COUNT(*) FROM coefficients c WHERE c.ModelID = m.ModelID) AS CoefficientCount,
  (SELECT COUNT(*) FROM results x WHERE x.ModelID = m.ModelID) AS ResultCount FROM models m""",
)
def _(spark, sf):
    """A model without results goes, and its coefficients with it."""
    t = survey_tables(spark, sf)
    unused = t.models.limit(1).withColumn("ModelID", F.lit(77))
    theirs = t.coefficients.withColumn("ModelID", F.lit(77)).dropDuplicates(["BiomarkerID"])
    wider = t.replace(models=t.models.unionByName(unused), coefficients=t.coefficients.unionByName(theirs))
    left = upsert.delete_models(wider, unused.select("ModelID"))
    parts = {"CoefficientCount": left.coefficients, "ResultCount": left.results}
    found = left.models.select("ModelID", "ModelName")
    for name, df in parts.items():
        found = found.join(df.groupBy("ModelID").agg(F.count(F.lit(1)).alias(name)), "ModelID", "left")
    return found.fillna(0, subset=list(parts))
