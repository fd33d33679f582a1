"""Registered chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspan.operators import quality, queries, series
from cohortspan.plans.api import _GAPS, comparison_sql
from cohortspan.plans.define import AS_OF, PARTS, query, r, rounded
from cohortspan.sources.star import derive, survey_tables

# Points as they arrive, in text form, with dates that cannot be drawn among them.
PARTS["drawn"] = (
    ("submission", "submitted_value"),
    """SELECT s.UserID, v.BiomarkerID, CAST(s.SessionDateText AS DATE) AS Date, CAST(v.Value AS DOUBLE) AS Value
  FROM submission s JOIN submitted_value v ON v.SubmissionID = s.SubmissionID
  WHERE s.SessionDateText <> 'not-a-date' AND v.Value IS NOT NULL""",
)
PARTS["history"] = (
    ("aged", "results", "models"),
    f"{_GAPS} FROM results x JOIN models o ON x.ModelID = o.ModelID JOIN aged a ON a.UserID = x.UserID",
)
PARTS["actual"] = (
    ("history",),
    """SELECT userId, computedAt, value FROM (SELECT userId, computedAt,
    CAST(bioAgeYears AS DOUBLE) - CAST(ageGap AS DOUBLE) AS value, row_number() OVER (PARTITION BY userId, computedAt
      ORDER BY modelId, CAST(bioAgeYears AS DOUBLE) - CAST(ageGap AS DOUBLE)) AS n FROM history) x WHERE n = 1""",
)
PARTS["compared"] = (("latest", "ranges", "aged"), comparison_sql())


def _padding(low: str, high: str) -> str:
    return (
        f"CASE WHEN {high} - {low} = 0 THEN greatest(abs({low}) * CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE))"
        f" ELSE ({high} - {low}) * CAST(0.1 AS DOUBLE) END"
    )


def _drawn(spark, sf):
    points = derive(spark, sf, "submission").join(derive(spark, sf, "submitted_value"), "SubmissionID")
    return series.trend_series(
        points.select(
            "UserID", "BiomarkerID", F.col("SessionDateText").alias("DateText"), F.col("Value").cast("string").alias("ValueText")
        )
    )


@query("trend_series", ["drawn"], "SELECT * FROM drawn")
def _(spark, sf):
    return _drawn(spark, sf)


@query(
    "trend_axis_domain",
    ["drawn"],
    f"""SELECT UserID, BiomarkerID, MinDate, MaxDate, {r("lo - " + _padding("lo", "hi"))} AS MinValue,
  {r("hi + " + _padding("lo", "hi"))} AS MaxValue FROM (SELECT UserID, BiomarkerID, MIN(Date) AS MinDate,
    MAX(Date) AS MaxDate, MIN(Value) AS lo, MAX(Value) AS hi FROM drawn GROUP BY UserID, BiomarkerID) x""",
)
def _(spark, sf):
    return rounded(series.trend_axis_domain(_drawn(spark, sf)), 6, "MinValue", "MaxValue")


@query(
    "history_series",
    ["history"],
    f"SELECT userId, modelName, computedAt, {r('CAST(ageGap AS DOUBLE)')} AS value FROM history WHERE ageGap IS NOT NULL",
)
def _(spark, sf):
    return rounded(series.history_series(survey_tables(spark, sf), AS_OF, "ageGap"), 6, "value")


@query("actual_age_series", ["actual"], f"SELECT userId, computedAt, {r('value')} AS value FROM actual")
def _(spark, sf):
    return rounded(series.actual_age_series(survey_tables(spark, sf), AS_OF), 6, "value")


def _domain_sql(points: str, least: str, most: str) -> str:
    return f"""SELECT userId, minDate, maxDate, {r(least)} AS minValue, {r(most)} AS maxValue
  FROM (SELECT userId, minDate, maxDate, lo - pad AS low, hi + pad AS high, pad
    FROM (SELECT *, {_padding("lo", "hi")} AS pad FROM (SELECT userId, MIN(computedAt) AS minDate,
      MAX(computedAt) AS maxDate, MIN(value) AS lo, MAX(value) AS hi FROM ({points}) p GROUP BY userId) s) t) x"""


@query(
    "history_axis_domain",
    ["history", "actual"],
    _domain_sql(
        """SELECT userId, computedAt, CAST(bioAgeYears AS DOUBLE) AS value FROM history
      UNION ALL SELECT userId, computedAt, value FROM actual""",
        "least(low, 0)",
        "high",
    ),
)
def _(spark, sf):
    return rounded(series.history_axis_domain(survey_tables(spark, sf), AS_OF), 6, "minValue", "maxValue")


@query(
    "history_axis_domain_gap",
    ["history"],
    _domain_sql(
        "SELECT userId, computedAt, CAST(ageGap AS DOUBLE) AS value FROM history",
        "CASE WHEN low > 0 THEN least(0, low - pad) ELSE least(low, CAST(-0.5 AS DOUBLE)) END",
        "CASE WHEN high < 0 THEN greatest(0, high + pad) ELSE greatest(high, CAST(0.5 AS DOUBLE)) END",
    ),
)
def _(spark, sf):
    return rounded(series.history_axis_domain(survey_tables(spark, sf), AS_OF, "ageGap"), 6, "minValue", "maxValue")


@query(
    "gap_class",
    ["history"],
    f"""SELECT userId, modelId, computedAt, ageGap, CASE WHEN abs(g) < 0.05 THEN 'neutral' WHEN g < -0.5 THEN 'younger'
    WHEN g < 0 THEN 'slightly_younger' WHEN g > 0.5 THEN 'older' ELSE 'slightly_older' END AS gapClass,
  {r("w")} AS barWidth, {r("CASE WHEN abs(g) < 0.05 THEN 50 - w / 2 WHEN g < 0 THEN 50 - w ELSE 50 END")} AS barLeft
  FROM (SELECT *, CAST(ageGap AS DOUBLE) AS g, CASE WHEN abs(CAST(ageGap AS DOUBLE)) < 0.05 THEN CAST(1.5 AS DOUBLE)
    ELSE greatest(least(abs(CAST(ageGap AS DOUBLE)) / 15 * 50, 50), CAST(0.5 AS DOUBLE)) END AS w FROM history) x""",
)
def _(spark, sf):
    history = queries.bio_age_history(survey_tables(spark, sf), AS_OF)
    classed = series.gap_class(history).select(
        "userId", "modelId", "computedAt", "ageGap", "gapClass", "barWidth", "barLeft"
    )
    return rounded(classed, 6, "barWidth", "barLeft")


# Bounds and value as doubles, and the padded axis around them.
PARTS["display"] = (
    ("compared",),
    """SELECT *, lo - (hi - lo) * CAST(0.1 AS DOUBLE) AS dmin, hi + (hi - lo) * CAST(0.1 AS DOUBLE) AS dmax
  FROM (SELECT *, least(v, c0, c1, l0, l1) AS lo, greatest(v, c0, c1, l0, l1) AS hi
    FROM (SELECT userId, biomarkerId, value, CAST(value AS DOUBLE) AS v, CAST(clinicalMin AS DOUBLE) AS c0,
      CAST(clinicalMax AS DOUBLE) AS c1, CAST(longevityMin AS DOUBLE) AS l0, CAST(longevityMax AS DOUBLE) AS l1
      FROM compared WHERE clinicalMin IS NOT NULL AND clinicalMax IS NOT NULL AND longevityMin IS NOT NULL
      AND longevityMax IS NOT NULL) a) b""",
)


@query(
    "range_bands",
    ["display"],
    f"""SELECT userId, biomarkerId, value, CAST(n AS INT) AS band, {r("p")} AS bandStart, {r("q")} AS bandEnd,
  CASE WHEN l0 <= (p + q) / 2 AND (p + q) / 2 < l1 THEN 'Optimal' WHEN c0 <= (p + q) / 2 AND (p + q) / 2 < c1 THEN 'Normal'
    ELSE 'OutOfRange' END AS label, {r("(q - p) / (dmax - dmin) * 100")} AS widthPercent
  FROM (SELECT *, row_number() OVER (PARTITION BY userId, biomarkerId, value ORDER BY p) AS n,
      lead(p) OVER (PARTITION BY userId, biomarkerId, value ORDER BY p) AS q
    FROM (SELECT userId, biomarkerId, value, c0, c1, l0, l1, dmin, dmax, p FROM display
      CROSS JOIN LATERAL (SELECT DISTINCT p FROM (VALUES (dmin), (c0), (c1), (l0), (l1), (dmax)) AS e(p)) d) x) y
  WHERE q IS NOT NULL""",
)
def _(spark, sf):
    bands = series.range_bands(queries.range_comparison(survey_tables(spark, sf)))
    return rounded(bands, 6, "bandStart", "bandEnd", "widthPercent")


@query(
    "range_bands_clinical",
    ["compared"],
    f"""SELECT userId, biomarkerId, value, CAST(n AS INT) AS band, {r("p")} AS bandStart, {r("q")} AS bandEnd,
  CASE WHEN n = k THEN 'Normal' ELSE 'OutOfRange' END AS label, {r("(q - p) / (dmax - dmin) * 100")} AS widthPercent
  FROM (SELECT userId, biomarkerId, value, c0, c1, dmin, dmax, unnest([1, 2, 3]) AS n, 2 AS k,
      unnest([dmin, c0, c1]) AS p, unnest([c0, c1, dmax]) AS q
    FROM (SELECT *, lo - (hi - lo) * CAST(0.1 AS DOUBLE) AS dmin, hi + (hi - lo) * CAST(0.1 AS DOUBLE) AS dmax
      FROM (SELECT *, least(v, c0, c1) AS lo, greatest(v, c0, c1) AS hi FROM (SELECT userId, biomarkerId, value,
        CAST(value AS DOUBLE) AS v, CAST(clinicalMin AS DOUBLE) AS c0, CAST(clinicalMax AS DOUBLE) AS c1
        FROM compared WHERE clinicalMin IS NOT NULL AND clinicalMax IS NOT NULL) a) b) c) d""",
)
def _(spark, sf):
    bands = series.range_bands(queries.range_comparison(survey_tables(spark, sf)), "clinical")
    return rounded(bands, 6, "bandStart", "bandEnd", "widthPercent")


@query(
    "range_marker",
    ["display"],
    f"""SELECT userId, biomarkerId, value, {r("dmin")} AS displayMin, {r("dmax")} AS displayMax,
  {r("least(greatest((v - dmin) / (dmax - dmin) * 100, 0), 100)")} AS markerPercent FROM display""",
)
def _(spark, sf):
    marked = series.range_marker(queries.range_comparison(survey_tables(spark, sf)))
    return rounded(marked, 6, "displayMin", "displayMax", "markerPercent")


@query(
    "range_axis_domain",
    ["ranges", "counted"],
    f"""SELECT x.BiomarkerID, x.RangeType, x.Sex, x.AgeMin, x.AgeMax, x.MinVal, x.MaxVal, {r("x.a0")} AS axisMin,
  {r("x.a1")} AS axisMax, {r("x.off")} AS barOffset,
  {r("greatest(least(greatest((x.hi - x.lo) / (x.a1 - x.a0) * 100, CAST(0.5 AS DOUBLE)), 100 - x.off), 0)")} AS barWidth,
  coalesce(c.MeasurementCount, 0) AS MeasurementCount
  FROM (SELECT *, greatest((lo - a0) / (a1 - a0) * 100, 0) AS off FROM (SELECT v.*, CAST(v.MinVal AS DOUBLE) AS lo,
      CAST(v.MaxVal AS DOUBLE) AS hi, s.lo - {_padding("s.lo", "s.hi")} AS a0, s.hi + {_padding("s.lo", "s.hi")} AS a1
    FROM ranges v JOIN (SELECT BiomarkerID, MIN(CAST(MinVal AS DOUBLE)) AS lo, MAX(CAST(MaxVal AS DOUBLE)) AS hi
      FROM ranges WHERE MinVal <= MaxVal GROUP BY BiomarkerID) s ON s.BiomarkerID = v.BiomarkerID
    WHERE v.MinVal <= v.MaxVal) w) x LEFT JOIN counted c ON c.BiomarkerID = x.BiomarkerID""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    axes = quality.with_measurements(series.range_axis_domain(t.ranges), t)
    return rounded(axes, 6, "axisMin", "axisMax", "barOffset", "barWidth")


@query(
    "session_ordinal",
    ["sessions"],
    """SELECT UserID, SessionID, SessionDate, CAST(row_number() OVER (PARTITION BY UserID ORDER BY SessionDate, SessionID)
  AS INT) AS Ordinal FROM sessions""",
)
def _(spark, sf):
    return series.session_ordinal(survey_tables(spark, sf))
