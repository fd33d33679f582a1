"""Registered scores, and SQL for them.

The distance is checked with another method than the one it is computed with: the SQL takes the
biomarkers one after another, removes from each what the earlier ones explain, and adds up squared
remainders over their variances. That needs no matrix inverse and gives the same distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.numbers import model_units
from cohortspan.operators import comoments, hd, pheno, scores
from cohortspan.operators.views import latest_measurements
from cohortspan.plans.define import AS_OF, MATERIALIZED, PARTS, query, r, rounded
from cohortspan.session import cut_lineage, scratch
from cohortspan.sources.star import survey_tables

_ALL = range(1, 10)
_QUOTED = {i: f'"{name}"' for i, name in zip(_ALL, hd.NAMES)}
_CELLS = ", ".join(f"AVG(CASE WHEN v.BiomarkerID = {i} THEN v.x END) AS b{i}" for i in _ALL)
_PROBES = [(i, j) for i in _ALL for j in range(i, 10)]


def _probe(i: int, j: int) -> str:
    cells = ", ".join(f"CAST({(k == i) + (k == j and j != i)} AS DOUBLE)" for k in _ALL)
    return f"SELECT 'p', {10 * i + j}, NULL, {cells}"


PARTS["hd_values"] = (
    ("latest",),
    """SELECT UserID, BiomarkerID, CASE WHEN BiomarkerID = 4 THEN CAST(Value AS DOUBLE) / CAST(18 AS DOUBLE)
    ELSE CAST(Value AS DOUBLE) END AS x FROM latest WHERE BiomarkerID BETWEEN 1 AND 9""",
)
PARTS["hd_wide"] = (("hd_values",), f"SELECT UserID, COUNT(*) AS n, {_CELLS} FROM hd_values v GROUP BY UserID")
PARTS["hd_ref"] = (
    ("candidates", "hd_values"),
    f"""SELECT c.UserID, c.Age, c.BMI, c.Sex, {_CELLS} FROM candidates c JOIN hd_values v ON v.UserID = c.UserID
  WHERE c.Sex IS NOT NULL GROUP BY c.UserID, c.Age, c.BMI, c.Sex HAVING """
    + " AND ".join(f"COUNT(CASE WHEN v.BiomarkerID = {i} THEN 1 END) > 0" for i in _ALL),
)
PARTS["hd_stats"] = (
    ("hd_ref",),
    "SELECT COUNT(*) AS n, "
    + ", ".join(f"AVG(b{i}) AS m{i}, STDDEV_SAMP(b{i}) AS s{i}" for i in _ALL)
    + " FROM hd_ref",
)
_Z = ", ".join(f"(b{i} - m{i}) / s{i} AS z{i}" for i in _ALL)
PARTS["hd_0"] = (
    ("hd_ref", "hd_stats", "hd_wide"),
    f"""SELECT 'r' AS tag, UserID AS id, Age AS age, {_Z} FROM hd_ref, hd_stats
  UNION ALL SELECT 't', UserID, NULL, {_Z} FROM hd_wide, hd_stats WHERE """
    + " AND ".join(f"b{i} IS NOT NULL" for i in _ALL)
    + "".join(" UNION ALL " + _probe(i, j) for i, j in _PROBES),
)
for _k in range(1, 9):
    _later = range(_k + 1, 10)
    PARTS[f"hd_c{_k}"] = (
        (f"hd_{_k - 1}",),
        "SELECT "
        + ", ".join(f"SUM(z{j} * z{_k}) / SUM(z{_k} * z{_k}) AS c{j}" for j in _later)
        + f" FROM hd_{_k - 1} WHERE tag = 'r'",
    )
    PARTS[f"hd_{_k}"] = (
        (f"hd_{_k - 1}", f"hd_c{_k}"),
        "SELECT tag, id, age, "
        + ", ".join(f"z{j} - c{j} * z{_k} AS z{j}" if j in _later else f"z{j}" for j in _ALL)
        + f" FROM hd_{_k - 1}, hd_c{_k}",
    )
PARTS["hd_d"] = (
    ("hd_8", "hd_stats"),
    "SELECT tag, id, age, sqrt((n - 1) * ("
    + " + ".join(f"z{i} * z{i} / q{i}" for i in _ALL)
    + ")) AS d FROM hd_8, hd_stats, (SELECT "
    + ", ".join(f"SUM(z{i} * z{i}) AS q{i}" for i in _ALL)
    + " FROM hd_8 WHERE tag = 'r') q",
)
PARTS["hd_line"] = (
    ("hd_d",),
    "SELECT regr_slope(d, age) AS slope, regr_intercept(d, age) AS intercept FROM hd_d WHERE tag = 'r'",
)
PARTS["hd_aged"] = (
    ("aged", "hd_wide", "hd_d"),
    """SELECT UserID, Age, BioAgeYears, round(BioAgeYears - Age, 2) AS AgeGap, CASE WHEN NOT Complete
    THEN 'insufficient_biomarkers' WHEN BioAgeYears IS NULL THEN 'invalid_value' ELSE 'ok' END AS Status
  FROM (SELECT a.UserID, a.Age, coalesce(w.n, 0) = 9 AS Complete,
      CASE WHEN coalesce(w.n, 0) = 9 THEN round(a.Age + (d.d - CAST(2.5 AS DOUBLE)) * 4, 2) END AS BioAgeYears
    FROM aged a LEFT JOIN hd_wide w ON w.UserID = a.UserID LEFT JOIN hd_d d ON d.id = a.UserID AND d.tag = 't') x""",
)
MATERIALIZED |= {"latest", "hd_wide", "hd_ref", "hd_stats", "hd_d", *[f"hd_{k}" for k in range(9)]}


@query(
    "unit_convert_glucose",
    ["latest"],
    f"""SELECT UserID, BiomarkerID, Value, {r("CASE WHEN BiomarkerID = 4 THEN CAST(Value AS DOUBLE) / CAST(18 AS DOUBLE) ELSE CAST(Value AS DOUBLE) END")}
  AS ModelValue FROM latest""",
)
def _(spark, sf):
    latest = latest_measurements(survey_tables(spark, sf)).select("UserID", "BiomarkerID", "Value")
    return rounded(
        latest.withColumn("ModelValue", model_units(F.col("BiomarkerID"), F.col("Value"))), 6, "ModelValue"
    )


@query("pheno_terms", ["terms"], f"SELECT UserID, BiomarkerID, {r('Term', 9)} AS Term FROM terms")
def _(spark, sf):
    t = survey_tables(spark, sf)
    return rounded(pheno.terms(latest_measurements(t), t.coefficients), 9, "Term")


@query("pheno_linear", ["linear"], f"SELECT UserID, BiomarkerCount, {r('LinearTerm', 9)} AS LinearTerm FROM linear")
def _(spark, sf):
    t = survey_tables(spark, sf)
    return rounded(pheno.linear(latest_measurements(t), t.coefficients), 9, "LinearTerm")


@query("q035_phenotypic_age", ["pheno"], "SELECT * FROM pheno")
def _(spark, sf):
    return pheno.phenotypic_age(survey_tables(spark, sf), AS_OF)


@query("q035_hd_age", ["hd_aged"], "SELECT * FROM hd_aged")
def _(spark, sf):
    t = survey_tables(spark, sf)
    wide = cut_lineage(hd.wide_values(latest_measurements(t)), "wide")
    model = hd.fit(hd.reference_wide(t, AS_OF, wide), age_column=None)
    return scores.hd_age(t, AS_OF, model, wide)


_BOTH = """SELECT UserID, 1 AS ModelID, 'Phenotypic Age' AS ModelName, Age, BioAgeYears, AgeGap, Status FROM pheno
  UNION ALL SELECT UserID, 2, 'Homeostatic Dysregulation', Age, BioAgeYears, AgeGap, Status FROM hd_aged"""


@query("q035_calculate", ["pheno", "hd_aged"], _BOTH)
def _(spark, sf):
    return scores.calculate(survey_tables(spark, sf), AS_OF)


@query(
    "append_results",
    ["pheno", "hd_aged", "results"],
    f"""SELECT UserID, ModelID, BioAgeYears, ComputedAt FROM results
  UNION ALL SELECT UserID, ModelID, CAST(BioAgeYears AS DECIMAL(5,2)), TIMESTAMP '{AS_OF} 00:00:00'
  FROM ({_BOTH}) b WHERE BioAgeYears IS NOT NULL""",
)
def _(spark, sf):
    t = survey_tables(spark, sf)
    folder = scratch(spark, "results")
    t.results.write.parquet(folder)
    scored = cut_lineage(scores.calculate(t, AS_OF))
    for _ in range(2):  # the second run finds its rows stored already
        scores.append_results(scored, f"{AS_OF} 00:00:00", folder)
    return spark.read.parquet(folder)


@query(
    "hd_reference_wide",
    ["hd_ref"],
    f"""SELECT UserID, Age, {r("CAST(BMI AS DOUBLE)")} AS BMI, Sex, """
    + ", ".join(f"{r(f'b{i}')} AS {_QUOTED[i]}" for i in _ALL)
    + " FROM hd_ref",
)
def _(spark, sf):
    return rounded(hd.reference_wide(survey_tables(spark, sf), AS_OF), 6, "BMI", *hd.NAMES)


def _stored_parts(spark, sf) -> DataFrame:
    """Co-moments of the reference group, a stored part per birth year."""
    t = survey_tables(spark, sf)
    return cut_lineage(comoments.summed(hd.reference_wide(t, AS_OF), by=["Age"]), "comoments")


@query(
    "hd_moments",
    ["hd_stats"],
    " UNION ALL ".join(
        f"SELECT '{name}' AS Biomarker, {r(f'm{i}')} AS Mean, {r(f's{i}')} AS Std, n AS ReferenceRows FROM hd_stats"
        for i, name in zip(_ALL, hd.NAMES)
    ),
)
def _(spark, sf):
    return rounded(comoments.deviations(comoments.merged(_stored_parts(spark, sf))), 6, "Mean", "Std")


@query(
    "hd_correlation",
    ["hd_ref"],
    " UNION ALL ".join(
        f"SELECT '{hd.NAMES[i - 1]}' AS BiomarkerA, '{hd.NAMES[j - 1]}' AS BiomarkerB, {r(f'corr(b{i}, b{j})')} AS Correlation FROM hd_ref"
        for i, j in _PROBES
        if i != j
    ),
)
def _(spark, sf):
    return rounded(comoments.correlation(comoments.merged(_stored_parts(spark, sf))), 6, "Correlation")


def _entry(i: int, j: int) -> str:
    square = "(SELECT d * d FROM hd_d WHERE tag = 'p' AND id = {})"
    if i == j:
        return square.format(11 * i)
    low, high = min(i, j), max(i, j)
    return f"({square.format(10 * low + high)} - {square.format(11 * i)} - {square.format(11 * j)}) / 2"


@query(
    "hd_precision",
    ["hd_d"],
    " UNION ALL ".join(
        f"SELECT '{hd.NAMES[i - 1]}' AS BiomarkerA, '{hd.NAMES[j - 1]}' AS BiomarkerB, {r(_entry(i, j))} AS Precision"
        for i in _ALL
        for j in _ALL
    ),
)
def _(spark, sf):
    model = hd.fit_population(survey_tables(spark, sf), AS_OF, with_years=False)
    rows = spark.createDataFrame(hd.precision_rows(model), "BiomarkerA STRING, BiomarkerB STRING, Precision DOUBLE")
    return rounded(rows, 6, "Precision")


def _wide_and_reference(spark, sf):
    t = survey_tables(spark, sf)
    wide = cut_lineage(hd.wide_values(latest_measurements(t)), "wide")
    return wide, cut_lineage(hd.reference_wide(t, AS_OF, wide), "reference")


@query("hd_score", ["hd_d"], f"SELECT id AS UserID, {r('d')} AS HD_score FROM hd_d WHERE tag = 't'")
def _(spark, sf):
    wide, reference = _wide_and_reference(spark, sf)
    model = hd.fit(reference, age_column=None)
    scored = wide.select("UserID", model.distance().alias("HD_score")).where("HD_score IS NOT NULL")
    return rounded(scored, 6, "HD_score")


@query(
    "hd_score_2d",
    ["hd_wide", "hd_ref"],
    f"""SELECT UserID, {r("sqrt((z1 * z1 - 2 * rho * z1 * z3 + z3 * z3) / (1 - rho * rho))")} AS HD_score
  FROM (SELECT w.UserID, (w.b1 - s.m1) / s.s1 AS z1, (w.b3 - s.m3) / s.s3 AS z3, s.rho FROM hd_wide w,
    (SELECT AVG(b1) AS m1, STDDEV_SAMP(b1) AS s1, AVG(b3) AS m3, STDDEV_SAMP(b3) AS s3, corr(b1, b3) AS rho
     FROM hd_ref) s WHERE w.b1 IS NOT NULL AND w.b3 IS NOT NULL) x""",
)
def _(spark, sf):
    wide, reference = _wide_and_reference(spark, sf)
    model = hd.fit(reference, ("Albumin", "Creatinine"), age_column=None)
    scored = wide.select("UserID", model.distance().alias("HD_score")).where("HD_score IS NOT NULL")
    return rounded(scored, 6, "HD_score")


@query(
    "hd_age_regression",
    ["hd_line", "hd_stats"],
    f"SELECT {r('slope')} AS Slope, {r('intercept')} AS Intercept, n AS ReferenceRows FROM hd_line, hd_stats",
)
def _(spark, sf):
    reference = cut_lineage(hd.reference_wide(survey_tables(spark, sf), AS_OF))
    model = hd.fit(reference, age_column=None)
    line = hd.age_regression(reference, model).withColumn("ReferenceRows", F.lit(model.rows).cast("long"))
    return rounded(line, 6, "Slope", "Intercept")


_YEARS = r("slope * d + intercept")


@query(
    "hd_years",
    ["hd_d", "hd_line"],
    f"SELECT id AS UserID, {_YEARS} AS HD_years FROM hd_d, hd_line WHERE tag = 't'",
)
def _(spark, sf):
    wide, reference = _wide_and_reference(spark, sf)
    model = hd.fit(reference)
    scored = wide.select("UserID", model.years(model.distance()).alias("HD_years")).where("HD_years IS NOT NULL")
    return rounded(scored, 6, "HD_years")


@query(
    "hd_batch",
    ["hd_wide", "hd_d", "hd_line"],
    f"""SELECT w.UserID, {r("d")} AS HD_score, {_YEARS} AS HD_years FROM hd_wide w
  LEFT JOIN (SELECT * FROM hd_d, hd_line WHERE tag = 't') x ON x.id = w.UserID""",
)
def _(spark, sf):
    wide, reference = _wide_and_reference(spark, sf)
    scored = hd.batch(wide, hd.fit(reference)).select("UserID", "HD_score", "HD_years")
    return rounded(scored, 6, "HD_score", "HD_years")


@query(
    "hd_fit_and_score",
    ["hd_d", "hd_line"],
    f"SELECT id AS UserID, {r('d')} AS HD_score, {_YEARS} AS HD_years FROM hd_d, hd_line WHERE tag = 't'",
)
def _(spark, sf):
    wide, reference = _wide_and_reference(spark, sf)
    scored = hd.fit_and_score(wide, reference).select("UserID", "HD_score", "HD_years")
    return rounded(scored, 6, "HD_score", "HD_years")


@query("hd_invariant", ["hd_stats"], "SELECT n AS ReferenceRows, CAST(9 AS DOUBLE) AS SquaresPerFreedom FROM hd_stats")
def _(spark, sf):
    reference = cut_lineage(hd.reference_wide(survey_tables(spark, sf), AS_OF))
    model = hd.fit(reference, age_column=None)
    total = reference.select((model.distance() * model.distance()).alias("s")).agg(
        F.count("s").alias("ReferenceRows"), F.sum("s").alias("s")
    )
    ratio = total.select("ReferenceRows", (F.col("s") / (F.col("ReferenceRows") - 1)).alias("SquaresPerFreedom"))
    return rounded(ratio, 6, "SquaresPerFreedom")
