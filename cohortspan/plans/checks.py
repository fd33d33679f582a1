"""Registered data-quality checks.

Checks of stored rows run on staged submissions, which contain what such checks look for: unknown
users and biomarkers, repeated keys, missing dates and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.catalog import BIOMARKERS, COEFFICIENTS, values_sql
from cohortspan.functions.dates import iso_date
from cohortspan.operators import quality
from cohortspan.plans.define import AS_OF, PARTS, query
from cohortspan.schemas import NATURAL_KEYS, REFERENCES
from cohortspan.sources.star import derive, survey_tables
from cohortspan.tables import Tables

PARTS["stg_sessions"] = (
    ("submission",),
    """SELECT CAST(SubmissionID AS INT) AS SessionID, UserID, CASE WHEN SessionDateText <> 'not-a-date'
  THEN CAST(SessionDateText AS DATE) END AS SessionDate, FastingStatus FROM submission""",
)
PARTS["stg_measurements"] = (
    ("submitted_value",),
    f"""SELECT CAST(SubmissionID AS INT) AS SessionID, BiomarkerID, Value, TIMESTAMP '{AS_OF} 00:00:00' AS TakenAt
  FROM submitted_value""",
)
_STAGED = {"sessions": "stg_sessions", "measurements": "stg_measurements"}
_TABLES = [
    "users", "biomarkers", "ranges", "models", "coefficients", "anthropometry", "results", "stg_sessions", "stg_measurements"
]


def _sql_name(table: str) -> str:
    return _STAGED.get(table, table)


def staged_tables(spark, sf) -> Tables:
    """The base tables with submissions, as they came, in place of visits and measurements."""
    headers = derive(spark, sf, "submission").select(
        F.col("SubmissionID").cast("int").alias("SessionID"),
        "UserID",
        iso_date(F.col("SessionDateText")).alias("SessionDate"),
        "FastingStatus",
    )
    values = derive(spark, sf, "submitted_value").select(
        F.col("SubmissionID").cast("int").alias("SessionID"),
        "BiomarkerID",
        "Value",
        F.lit(f"{AS_OF} 00:00:00").cast("timestamp").alias("TakenAt"),
    )
    return survey_tables(spark, sf).replace(sessions=headers, measurements=values)


@query(
    "dq_row_counts",
    _TABLES,
    "SELECT TableName, RowCount, Expected, Expected IS NULL OR Expected = RowCount AS Ok FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS TableName, COUNT(*) AS RowCount, "
        f"CAST({quality.EXPECTED_ROWS.get(name, 'NULL')} AS INT) AS Expected FROM {_sql_name(name)}"
        for name in NATURAL_KEYS
    )
    + ") x",
)
def _(spark, sf):
    return quality.row_counts(staged_tables(spark, sf))


def _duplicates(name: str, keys: list[str]) -> str:
    columns = ", ".join(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT '{name}' AS TableName, '{','.join(keys)}' AS KeyColumns, COUNT(*) AS DuplicateKeys, "
        f"CAST(coalesce(SUM(n - 1), 0) AS BIGINT) AS ExtraRows FROM (SELECT COUNT(*) AS n FROM {_sql_name(name)} "
        f"WHERE {known} GROUP BY {columns} HAVING COUNT(*) > 1) x"
    )


@query("dq_unique", _TABLES, " UNION ALL ".join(_duplicates(name, keys) for name, keys in NATURAL_KEYS.items()))
def _(spark, sf):
    return quality.unique_keys_of(staged_tables(spark, sf))


@query(
    "dq_foreign_keys",
    _TABLES,
    " UNION ALL ".join(
        f"SELECT '{name}' AS ForeignKey, COUNT(DISTINCT c.{column}) AS OrphanKeys, COUNT(*) AS OrphanRows "
        f"FROM {_sql_name(child)} c WHERE c.{column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {_sql_name(parent)} p WHERE p.{column} = c.{column})"
        for name, child, column, parent in REFERENCES
    ),
)
def _(spark, sf):
    return quality.foreign_keys(staged_tables(spark, sf))


_RULES = [
    ("users", "UserID", "null", "UserID IS NULL"),
    ("users", "Sex", "not_in_domain", "Sex NOT IN ('M', 'F')"),
    ("sessions", "SessionID", "null", "SessionID IS NULL"),
    ("sessions", "UserID", "null", "UserID IS NULL"),
    ("sessions", "SessionDate", "null", "SessionDate IS NULL"),
    ("measurements", "SessionID", "null", "SessionID IS NULL"),
    ("measurements", "BiomarkerID", "null", "BiomarkerID IS NULL"),
    ("measurements", "Value", "null", "Value IS NULL"),
    ("measurements", "Value", "out_of_range", "abs(Value) >= 100000000"),
    ("measurements", "TakenAt", "null", "TakenAt IS NULL"),
]


@query(
    "dq_domains",
    ["users", "stg_sessions", "stg_measurements"],
    " UNION ALL ".join(
        f"SELECT '{table}' AS TableName, '{column}' AS ColumnName, '{rule}' AS Rule, COUNT(*) AS BadRows "
        f"FROM {_sql_name(table)} WHERE {bad}"
        for table, column, rule, bad in _RULES
    ),
)
def _(spark, sf):
    t = staged_tables(spark, sf)
    return quality.domains({"users": t.users, "sessions": t.sessions, "measurements": t.measurements})


@query(
    "dq_columns",
    ["submission", "submitted_value"],
    """SELECT 'sessions' AS TableName, 'SessionID' AS ColumnName, 'missing' AS Problem, COUNT(*) AS RowCount FROM submission
  UNION ALL SELECT 'sessions', 'SessionDate', 'missing', COUNT(*) FROM submission
  UNION ALL SELECT 'measurements', 'SessionID', 'missing', COUNT(*) FROM submitted_value
  UNION ALL SELECT 'measurements', 'BiomarkerID', 'bigint instead of int', COUNT(*) FROM submitted_value
  UNION ALL SELECT 'measurements', 'TakenAt', 'missing', COUNT(*) FROM submitted_value""",
)
def _(spark, sf):
    incoming = {
        "sessions": derive(spark, sf, "submission"),
        "measurements": derive(spark, sf, "submitted_value").withColumn("BiomarkerID", F.col("BiomarkerID").cast("long")),
    }
    return _with_row_counts(quality.columns(incoming), incoming)


def _with_row_counts(problems: list[tuple[str, str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """The problems found in the schemas beside the number of rows each one concerns."""
    result = None
    for name, df in tables.items():
        found = [(column, problem) for table, column, problem in problems if table == name]
        if not found:
            continue
        cells = [F.struct(F.lit(c).alias("ColumnName"), F.lit(p).alias("Problem")) for c, p in found]
        counted = df.agg(F.count(F.lit(1)).alias("RowCount"))
        part = counted.select(F.lit(name).alias("TableName"), F.explode(F.array(*cells)).alias("c"), "RowCount")
        part = part.select("TableName", "c.ColumnName", "c.Problem", "RowCount")
        result = part if result is None else result.unionByName(part)
    return result


_NAMES = {number: name for number, name, *_ in BIOMARKERS}
_PUBLISHED = values_sql([(_NAMES[b].lower(), c) for _, b, c, _ in COEFFICIENTS], "Key STRING, Expected DOUBLE")


@query(
    "dq_coefficients",
    ["coefficients", "models", "biomarkers", "counted"],
    f"""SELECT coalesce(s.Key, p.Key) AS Biomarker, s.Stored, p.Expected, CASE WHEN s.Stored IS NULL THEN 'missing'
  WHEN p.Expected IS NULL THEN 'unexpected' WHEN abs(s.Stored - p.Expected) > 0.000001 THEN 'different' ELSE 'ok' END AS Status,
  coalesce(c.MeasurementCount, 0) AS MeasurementCount
  FROM (SELECT b.BiomarkerID, lower(b.Name) AS Key, CAST(k.Coefficient AS DOUBLE) AS Stored FROM coefficients k
    JOIN models m ON m.ModelID = k.ModelID JOIN biomarkers b ON b.BiomarkerID = k.BiomarkerID
    WHERE lower(m.ModelName) = 'phenotypic age') s
  FULL OUTER JOIN ({_PUBLISHED}) p ON p.Key = s.Key LEFT JOIN counted c ON c.BiomarkerID = s.BiomarkerID""",
)
def _(spark, sf):
    return quality.coefficients(survey_tables(spark, sf))


@query(
    "dq_model_completeness",
    ["models", "coefficients", "counted"],
    """SELECT m.ModelID, m.ModelName, COUNT(k.BiomarkerID) AS BiomarkerCount,
  COUNT(CASE WHEN k.Transform = 'log' THEN 1 END) AS LogTransforms,
  CAST(coalesce(SUM(c.MeasurementCount), 0) AS BIGINT) AS MeasurementCount
  FROM models m LEFT JOIN coefficients k ON k.ModelID = m.ModelID LEFT JOIN counted c ON c.BiomarkerID = k.BiomarkerID
  GROUP BY m.ModelID, m.ModelName""",
)
def _(spark, sf):
    return quality.model_completeness(survey_tables(spark, sf))


@query(
    "dq_range_coverage",
    ["biomarkers", "ranges", "counted"],
    """SELECT b.BiomarkerID, b.Name, COUNT(CASE WHEN x.RangeType = 'clinical' THEN 1 END) AS Clinical,
  COUNT(CASE WHEN x.RangeType = 'longevity' THEN 1 END) AS Longevity, COUNT(DISTINCT x.Sex) AS Sexes,
  coalesce(MAX(c.MeasurementCount), 0) AS MeasurementCount, b.BiomarkerID NOT IN (1, 2, 3, 4, 5, 9)
    OR COUNT(CASE WHEN x.RangeType = 'clinical' THEN 1 END) > 0 AS Ok
  FROM biomarkers b LEFT JOIN ranges x ON x.BiomarkerID = b.BiomarkerID
  LEFT JOIN counted c ON c.BiomarkerID = b.BiomarkerID GROUP BY b.BiomarkerID, b.Name""",
)
def _(spark, sf):
    return quality.range_coverage(survey_tables(spark, sf))


@query(
    "dq_hd_population",
    ["candidates", "latest"],
    """SELECT COUNT(*) AS Candidates, MIN(Age) AS MinAge, MAX(Age) AS MaxAge, MIN(BMI) AS MinBMI, MAX(BMI) AS MaxBMI,
  (SELECT COUNT(*) FROM candidates c JOIN latest l ON l.UserID = c.UserID) AS JoinedRows,
  MIN(BMI) >= 18.5 AND MAX(BMI) < 30.0 AS BmiOk FROM candidates""",
)
def _(spark, sf):
    return quality.hd_population(survey_tables(spark, sf), AS_OF)


@query(
    "dq_catalog_order",
    ["biomarkers", "counted"],
    f"""SELECT coalesce(b.BiomarkerID, e.BiomarkerID) AS BiomarkerID, upper(b.NHANESVarCode) AS FoundCode, e.ExpectedCode,
  coalesce(c.MeasurementCount, 0) AS MeasurementCount, upper(b.NHANESVarCode) IS NOT DISTINCT FROM e.ExpectedCode AS Ok
  FROM biomarkers b FULL OUTER JOIN ({values_sql([(n, code) for n, _, code, *_ in BIOMARKERS], "BiomarkerID INT, ExpectedCode STRING")}) e
  ON e.BiomarkerID = b.BiomarkerID LEFT JOIN counted c ON c.BiomarkerID = b.BiomarkerID""",
)
def _(spark, sf):
    return quality.catalog_order(survey_tables(spark, sf))


@query(
    "dq_five_table_join",
    ["biomarkers", "measurements", "sessions", "users", "anthropometry"],
    """SELECT b.BiomarkerID, b.Name, COUNT(m.Value) AS MeasurementCount FROM biomarkers b
  LEFT JOIN measurements m ON b.BiomarkerID = m.BiomarkerID LEFT JOIN sessions s ON m.SessionID = s.SessionID
  LEFT JOIN users u ON s.UserID = u.UserID LEFT JOIN anthropometry a ON u.UserID = a.UserID
  GROUP BY b.BiomarkerID, b.Name""",
)
def _(spark, sf):
    return quality.five_table_join(survey_tables(spark, sf))


@query(
    "dq_summary",
    ["biomarkers", "ranges", "models", "coefficients", "candidates", "users", "measurements"],
    """SELECT (SELECT COUNT(*) FROM biomarkers) AS biomarkers, (SELECT COUNT(*) FROM ranges) AS reference_ranges,
  (SELECT COUNT(*) FROM ranges WHERE RangeType = 'clinical') AS clinical_ranges,
  (SELECT COUNT(*) FROM ranges WHERE RangeType = 'longevity') AS longevity_ranges,
  (SELECT COUNT(*) FROM models) AS models, (SELECT COUNT(*) FROM coefficients) AS coefficients,
  (SELECT COUNT(*) FROM candidates) AS hd_reference_candidates, (SELECT COUNT(*) FROM users) AS users,
  (SELECT COUNT(*) FROM measurements) AS measurements""",
)
def _(spark, sf):
    return quality.summary(survey_tables(spark, sf), AS_OF)
