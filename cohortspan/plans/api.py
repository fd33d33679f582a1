"""Registered views and numbered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.functions.dates import duration_days
from cohortspan.operators import queries as q
from cohortspan.operators import latest, quality, views
from cohortspan.plans.define import AS_OF, query
from cohortspan.session import cut_lineage, scratch
from cohortspan.sources.star import derive, survey_tables


@query("v_user_latest_measurements", ["latest"], "SELECT * FROM latest")
def _(spark, sf):
    return views.latest_measurements(survey_tables(spark, sf))


# What the stored latest table is made from; the visits after it arrive in two loads.
_LOADED_UNTIL = ["1996-01-01", "1999-01-01", "9999-12-31"]


@query("v_user_latest_merged", ["latest"], "SELECT * FROM latest")
def _(spark, sf):
    t = survey_tables(spark, sf)
    values = cut_lineage(t.measured().select(*latest.COLUMNS), "measured")
    day = F.to_date("TakenAt")
    table = latest.create(spark, scratch(spark, "latest"), values.where(day < _LOADED_UNTIL[0]), 8)
    for since, until in zip(_LOADED_UNTIL, _LOADED_UNTIL[1:]):
        table = latest.merge(table, values.where((day >= since) & (day < until)))
    return latest.view(table, t)


@query(
    "v_biomarker_ranges",
    ["biomarkers", "ranges", "counted"],
    """SELECT b.BiomarkerID, b.Name, b.Units, x.RangeType, x.Sex, x.AgeMin, x.AgeMax, x.MinVal, x.MaxVal,
  coalesce(c.MeasurementCount, 0) AS MeasurementCount FROM biomarkers b
  LEFT JOIN ranges x ON b.BiomarkerID = x.BiomarkerID LEFT JOIN counted c ON c.BiomarkerID = b.BiomarkerID""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return quality.with_measurements(views.biomarker_ranges(t), t)


@query("v_hd_reference_candidates", ["candidates"], "SELECT * FROM candidates")
def _(spark, sf):
    return views.hd_reference_candidates(survey_tables(spark, sf), AS_OF)


@query(
    "v_user_anthro_history",
    ["users", "anthropometry"],
    # The labels and the limits between them.
    """SELECT UserID, SEQN, ExamDate, BMI, HeightCM, WeightKG, coalesce((SELECT label FROM (VALUES (0, 18.5, 'Underweight'),
    (18.5, 25, 'Normal'), (25, 30, 'Overweight')) AS class(low, high, label) WHERE low <= BMI AND BMI < high), 'Obese')
  AS BMI_Category FROM anthropometry JOIN users USING (UserID)""",
)
def _(spark, sf):
    return views.anthropometry_history(survey_tables(spark, sf))


@query("v_user_with_age", ["aged"], "SELECT UserID, SEQN, BirthDate, Sex, RaceEthnicity, Age FROM aged")
def _(spark, sf):
    return views.users_with_age(survey_tables(spark, sf), AS_OF)


@query(
    "q01_list_users",
    ["aged", "sessions"],
    """SELECT UserID AS userId, SEQN AS seqn, Age AS age, Sex AS sex, RaceEthnicity AS raceEthnicity,
  CAST((SELECT COUNT(*) FROM sessions WHERE sessions.UserID = aged.UserID) AS BIGINT) AS sessionCount FROM aged""",
)
def _(spark, sf):
    return q.list_users(survey_tables(spark, sf), AS_OF)


_PROFILE = """SELECT a.UserID AS userId, a.SEQN AS seqn, a.BirthDate AS birthDate, a.Sex AS sex,
  a.RaceEthnicity AS raceEthnicity, a.Age AS age, l.BiomarkerID AS biomarkerId, l.BiomarkerName AS name,
  l.Value AS value, l.Units AS units, l.TakenAt AS takenAt FROM aged a LEFT JOIN latest l ON a.UserID = l.UserID"""


@query("q02_user_profile", ["aged", "latest"], _PROFILE)
def _(spark, sf):
    return q.user_profile(survey_tables(spark, sf), AS_OF)


@query(
    "q02b_profile_nested",
    ["aged", "latest"],
    f"""SELECT userId, age, sex, string_agg(CAST(biomarkerId AS VARCHAR) || '=' || CAST(value AS VARCHAR) || ' ' || units, '; '
  ORDER BY biomarkerId) AS biomarkers FROM ({_PROFILE}) p GROUP BY userId, age, sex""",
)
def _(spark, sf):
    nested = q.user_profile_nested(survey_tables(spark, sf), AS_OF)
    text = F.transform(
        "biomarkers",
        lambda b: F.concat(b["biomarkerId"].cast("string"), F.lit("="), b["value"].cast("string"), F.lit(" "), b["units"]),
    )
    return nested.select(
        F.col("UserID").alias("userId"),
        F.col("user.age").alias("age"),
        F.col("user.sex").alias("sex"),
        F.when(F.col("biomarkers").isNotNull(), F.array_join(text, "; ")).alias("biomarkers"),
    )


_GAPS = """SELECT x.UserID AS userId, x.ModelID AS modelId, o.ModelName AS modelName, x.BioAgeYears AS bioAgeYears,
  CAST(x.BioAgeYears - a.Age AS DECIMAL(8,2)) AS ageGap, x.ComputedAt AS computedAt"""


@query(
    "q03_bio_age",
    ["aged", "results", "models"],
    f"{_GAPS} FROM results x JOIN models o ON x.ModelID = o.ModelID JOIN aged a ON a.UserID = x.UserID",
)
def _(spark, sf):
    return q.bio_age(survey_tables(spark, sf), AS_OF)


@query(
    "q03b_bio_age_latest",
    ["aged", "results", "models"],
    f"""{_GAPS} FROM (SELECT *, row_number() OVER (PARTITION BY UserID, ModelID
    ORDER BY ComputedAt DESC, BioAgeYears DESC) AS n FROM results) x
  JOIN models o ON x.ModelID = o.ModelID JOIN aged a ON a.UserID = x.UserID WHERE x.n = 1""",
)
def _(spark, sf):
    return q.bio_age_latest(survey_tables(spark, sf), AS_OF)


@query(
    "q07_bio_age_history",
    ["aged", "results", "models"],
    f"""{_GAPS} FROM results x JOIN models o ON x.ModelID = o.ModelID JOIN aged a ON a.UserID = x.UserID
  WHERE o.ModelName = 'Phenotypic Age'""",
)
def _(spark, sf):
    return q.bio_age_history(survey_tables(spark, sf), AS_OF, "Phenotypic Age")


def comparison_sql(ranges: str = "ranges", age: bool = False) -> str:
    """Each kind of range is looked up by itself and the hits are added up, where the operator aggregates once."""
    # Names of the ranges and of the three outcomes.
    kinds, outcomes = ("clinical", "longevity"), {2: "Optimal", 1: "Normal"}
    fits = "r.BiomarkerID = p.BiomarkerID AND (r.Sex = 'All' OR r.Sex = p.Sex)"
    fits += " AND p.Age >= r.AgeMin AND p.Age <= r.AgeMax" if age else ""
    hits = f"(SELECT COUNT(*) FROM {ranges} r WHERE {fits} AND p.Value BETWEEN r.MinVal AND r.MaxVal)"
    bounds = ", ".join(
        f"(SELECT max({side}Val) FROM {ranges} r WHERE {fits} AND r.RangeType = '{kind}') AS {kind}{side}"
        for kind in kinds
        for side in ("Min", "Max")
    )
    status = " ".join(f"WHEN {n} THEN '{label}'" for n, label in outcomes.items())
    return f"""SELECT UserID AS userId, BiomarkerID AS biomarkerId, BiomarkerName AS name, Value AS value,
  CASE CAST(hits * copies AS INT) {status} ELSE 'OutOfRange' END AS status, clinicalMin, clinicalMax, longevityMin, longevityMax
  FROM (SELECT p.*, {hits} AS hits, {bounds}, (SELECT COUNT(*) FROM {ranges} r WHERE {fits}) AS known
    FROM (SELECT l.UserID, l.BiomarkerID, l.BiomarkerName, l.Value, a.Sex, a.Age, COUNT(*) AS copies
      FROM latest l JOIN aged a USING (UserID) GROUP BY ALL) p) c WHERE known > 0"""


@query("q05_range_comparison", ["latest", "ranges", "aged"], comparison_sql())
def _(spark, sf):
    return q.range_comparison(survey_tables(spark, sf))


@query("q05b_range_comparison_age", ["latest", "ranges_etl", "aged"], comparison_sql("ranges_etl", age=True))
def _(spark, sf):
    return q.range_comparison(survey_tables(spark, sf, "etl"), AS_OF, match_age=True)


@query(
    "q05c_range_type_filter",
    ["latest", "ranges", "aged"],
    f"""SELECT userId, biomarkerId, name, value, status, longevityMin AS rangeMin, longevityMax AS rangeMax
  FROM ({comparison_sql()}) c WHERE longevityMin IS NOT NULL OR longevityMax IS NOT NULL""",
)
def _(spark, sf):
    return q.range_comparison(survey_tables(spark, sf), only="longevity")


def _json_range(kind: str) -> str:
    low, high = f"{kind}Min", f"{kind}Max"
    text = f"""concat('{{"min":', CAST({low} AS VARCHAR), ',"max":', CAST({high} AS VARCHAR), '}}')"""
    return f"CASE WHEN {low} IS NOT NULL OR {high} IS NOT NULL THEN {text} END AS {kind}Range"


@query(
    "q05d_ranges_as_json",
    ["latest", "ranges", "aged"],
    f"""SELECT userId, biomarkerId, name, value, status, {_json_range("clinical")}, {_json_range("longevity")}
  FROM ({comparison_sql()}) c""",
)
def _(spark, sf):
    return q.ranges_as_json(q.range_comparison(survey_tables(spark, sf)))


@query(
    "q06_trend",
    ["measurements", "sessions"],
    f"""SELECT UserID AS userId, BiomarkerID AS biomarkerId, SessionDate AS date, Value AS value, SessionID AS sessionId
  FROM (SELECT s.UserID, m.BiomarkerID, s.SessionDate, m.Value, m.SessionID, row_number() OVER (PARTITION BY s.UserID,
      m.BiomarkerID ORDER BY s.SessionDate DESC, m.SessionID DESC) AS n
    FROM measurements m JOIN sessions s ON m.SessionID = s.SessionID
    WHERE s.SessionDate > DATE '{AS_OF}' - 4 * 365) x WHERE n <= 20""",
)
def _(spark, sf):
    return q.trend(survey_tables(spark, sf), AS_OF, limit=20, within="4 years")


_VISIT = """SELECT s.UserID AS userId, s.SessionID AS sessionId, s.SessionDate AS sessionDate,
  s.FastingStatus AS fastingStatus, m.BiomarkerID AS biomarkerId, b.Name AS name, m.Value AS value, b.Units AS units
  FROM sessions s JOIN measurements m ON s.SessionID = m.SessionID JOIN biomarkers b ON m.BiomarkerID = b.BiomarkerID"""


@query("q08_session_details", ["sessions", "measurements", "biomarkers"], _VISIT)
def _(spark, sf):
    return q.session_details(survey_tables(spark, sf))


@query(
    "q08b_session_details_nested",
    ["sessions", "measurements", "biomarkers"],
    f"""SELECT userId, sessionId, sessionDate, fastingStatus, COUNT(*) AS n,
  string_agg(concat(name, '=', CAST(value AS VARCHAR)), '; ' ORDER BY biomarkerId) AS measurements
  FROM ({_VISIT}) v GROUP BY userId, sessionId, sessionDate, fastingStatus""",
)
def _(spark, sf):
    nested = q.session_details_nested(survey_tables(spark, sf))
    text = F.transform("measurements", lambda m: F.concat(m["name"], F.lit("="), m["value"].cast("string")))
    return nested.withColumn("n", F.size("measurements").cast("long")).withColumn(
        "measurements", F.array_join(text, "; ")
    )


@query(
    "q085_user_sessions",
    ["sessions"],
    """SELECT UserID AS userId, SessionID AS sessionId, SessionDate AS sessionDate, FastingStatus AS fastingStatus
  FROM sessions""",
)
def _(spark, sf):
    return q.user_sessions(survey_tables(spark, sf))


@query(
    "q09_catalog",
    ["biomarkers", "counted"],
    """SELECT b.BiomarkerID AS biomarkerId, b.Name AS name, b.Units AS units, b.Description AS description,
  b.NHANESVarCode AS nhanesVarCode, coalesce(c.MeasurementCount, 0) AS MeasurementCount
  FROM biomarkers b LEFT JOIN counted c ON b.BiomarkerID = c.BiomarkerID""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    return quality.with_measurements(
        q.biomarker_catalog(t).withColumnRenamed("biomarkerId", "BiomarkerID"), t
    ).withColumnRenamed("BiomarkerID", "biomarkerId")


_USAGE = """SELECT x.BiomarkerID, x.RangeType, x.Sex, x.AgeMin, x.AgeMax, x.MinVal, x.MaxVal,
  COUNT(m.Value) AS MeasurementCount,
  COUNT(CASE WHEN x.MinVal <= m.Value AND m.Value <= x.MaxVal THEN 1 END) AS InsideCount
  FROM {ranges} x LEFT JOIN measurements m ON x.BiomarkerID = m.BiomarkerID
  GROUP BY x.BiomarkerID, x.RangeType, x.Sex, x.AgeMin, x.AgeMax, x.MinVal, x.MaxVal"""


@query(
    "q10_biomarker_ranges",
    ["ranges", "measurements"],
    f"""SELECT BiomarkerID AS biomarkerId, RangeType AS rangeType, Sex AS sex, AgeMin AS ageMin, AgeMax AS ageMax,
  MinVal AS minVal, MaxVal AS maxVal, InsideCount AS insideCount FROM ({_USAGE.format(ranges="ranges")}) u""",
)
def _(spark, sf):
    usage = quality.range_usage(survey_tables(spark, sf))
    renamed = {c: c[0].lower() + c[1:].replace("ID", "Id") for c in usage.columns}
    return usage.drop("MeasurementCount").withColumnsRenamed(renamed)


@query(
    "q11_age_distribution",
    ["aged"],
    """SELECT CASE WHEN Age < 30 THEN '20-29' WHEN Age < 40 THEN '30-39' WHEN Age < 50 THEN '40-49' ELSE '60+' END AS AgeGroup,
  Sex, COUNT(*) AS UserCount FROM aged GROUP BY 1, 2""",
)
def _(spark, sf):
    return q.age_distribution(survey_tables(spark, sf), AS_OF)


@query(
    "q11b_age_distribution_rollup",
    ["aged"],
    """SELECT AgeGroup, Sex, CAST(GROUPING(AgeGroup, Sex) AS INT) AS Level, COUNT(*) AS UserCount
  FROM (SELECT CASE WHEN Age IS NULL THEN 'unknown' WHEN Age < 20 THEN '0-19' WHEN Age < 30 THEN '20-29'
    WHEN Age < 40 THEN '30-39' WHEN Age < 50 THEN '40-49' WHEN Age < 60 THEN '50-59' ELSE '60+' END AS AgeGroup, Sex
    FROM aged) g GROUP BY ROLLUP (AgeGroup, Sex)""",
)
def _(spark, sf):
    return q.age_distribution_rollup(survey_tables(spark, sf), AS_OF)


@query(
    "q12_measurement_summary",
    ["biomarkers", "measurements"],
    """SELECT b.Name, b.Units, COUNT(m.SessionID) AS MeasurementCount FROM biomarkers b
  LEFT JOIN measurements m ON b.BiomarkerID = m.BiomarkerID GROUP BY b.Name, b.Units""",
)
def _(spark, sf):
    return q.measurement_summary(survey_tables(spark, sf))


@query(
    "demo_user_counts",
    ["users", "sessions", "measurements"],
    """SELECT u.UserID, u.SEQN, COUNT(DISTINCT s.SessionID) AS Sessions, COUNT(DISTINCT m.BiomarkerID) AS Biomarkers
  FROM users u LEFT JOIN sessions s ON u.UserID = s.UserID LEFT JOIN measurements m ON s.SessionID = m.SessionID
  GROUP BY u.UserID, u.SEQN""",
)
def _(spark, sf):
    return q.demo_user_counts(survey_tables(spark, sf))


@query(
    "json_model_metadata",
    ["models", "results"],
    """SELECT m.ModelID, m.ModelName, json_extract_string(m.FormulaJSON, '$.algorithm') AS algorithm,
  json_extract_string(m.FormulaJSON, '$.pmid') AS pmid,
  CAST(json_extract_string(m.FormulaJSON, '$.intercept') AS DOUBLE) AS intercept,
  CAST(json_extract_string(m.FormulaJSON, '$.age_coef') AS DOUBLE) AS ageCoefficient,
  CAST(json_extract_string(m.FormulaJSON, '$.biomarkers') AS INT) AS biomarkers, coalesce(x.n, 0) AS ResultCount
  FROM models m LEFT JOIN (SELECT ModelID, COUNT(*) AS n FROM results GROUP BY ModelID) x ON x.ModelID = m.ModelID""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    counts = t.results.groupBy("ModelID").agg(F.count(F.lit(1)).alias("ResultCount"))
    return q.model_metadata(t).join(counts, "ModelID", "left").fillna(0, subset=["ResultCount"])


@query(
    "parse_range_text",
    ["range_text"],
    r"""SELECT RequestID, RangeText, CAST(try_cast(regexp_extract(low, '^\s*(\d+)\s*(day|week|month|year)s?\s*$', 1) AS BIGINT)
  * CASE regexp_extract(low, '^\s*(\d+)\s*(day|week|month|year)s?\s*$', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7
    WHEN 'month' THEN 31 WHEN 'year' THEN 365 END AS BIGINT) AS Days
  FROM (SELECT *, lower(RangeText) AS low FROM range_text) x""",
)
def _(spark, sf):
    return derive(spark, sf, "range_text").withColumn("Days", duration_days(F.col("RangeText")))
