"""Catalog tables: biomarkers, models, coefficients and reference ranges.

Joined by their few keys they must never be shuffled, so they carry a broadcast hint. The built-in
ones are literals of a known number of rows; for stored ones ``bounded`` counts first.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, name, survey variable code, unit, description.
BIOMARKERS = [
    (1, "Albumin", "LBXSAL", "g/dL", "Serum albumin concentration"),
    (2, "Alkaline Phosphatase", "LBXSAPSI", "U/L", "Alkaline phosphatase enzyme activity"),
    (3, "Creatinine", "LBXSCR", "mg/dL", "Serum creatinine concentration"),
    (4, "Fasting Glucose", "LBXGLU", "mg/dL", "Plasma fasting glucose level"),
    (5, "High-Sensitivity CRP", "LBXHSCRP", "mg/L", "High-sensitivity C-reactive protein"),
    (6, "White Blood Cell Count", "LBXWBCSI", "10³ cells/µL", "White blood cell count"),
    (7, "Lymphocyte Percentage", "LBXLYPCT", "%", "Percentage of lymphocytes in WBC"),
    (8, "Mean Corpuscular Volume", "LBXMCVSI", "fL", "Average volume of red blood cells"),
    (9, "Red Cell Distribution Width", "LBXRDW", "%", "RBC size variation coefficient"),
]

PHENOTYPIC_AGE = 1
HOMEOSTATIC_DYSREGULATION = 2
GLUCOSE = 4

# The two models and the metadata stored with them.
MODELS = [
    (
        1,
        "Phenotypic Age",
        "Levine et al. 2018 Phenotypic Age based on 9 biomarkers",
        json.dumps(
            {
                "algorithm": "regression",
                "intercept": -19.9067,
                "age_coef": 0.0336,
                "biomarkers": 9,
                "reference": "Levine ME et al. 2018",
                "pmid": "29676998",
                "validation": "NHANES III",
            }
        ),
    ),
    (
        2,
        "Homeostatic Dysregulation",
        "Mahalanobis distance from healthy young adult reference",
        json.dumps(
            {
                "algorithm": "mahalanobis_distance",
                "reference_age_min": 20,
                "reference_age_max": 30,
                "reference_criteria": "BMI < 30, biomarkers in clinical range",
                "distance_metric": "Mahalanobis",
                "biomarkers": 9,
                "units": "HD_score_or_years",
                "references": ["Cohen 2013 PMC3964022", "Belsky 2015 PMC4693454"],
                "validation": "Multiple NHANES cohorts",
            }
        ),
    ),
]

# Model id, biomarker id, coefficient, transform (published regression weights).
COEFFICIENTS = [
    (1, 1, "-0.0336", "linear"),
    (1, 2, "0.00188", "linear"),
    (1, 3, "0.0095", "linear"),
    (1, 4, "0.1953", "linear"),
    (1, 5, "0.0954", "log"),
    (1, 6, "0.0554", "log"),
    (1, 7, "-0.0120", "linear"),
    (1, 8, "0.0268", "linear"),
    (1, 9, "0.3306", "linear"),
]

# Biomarker id, sex, clinical min and max, longevity min and max, youngest age.
_SEED_BOUNDS = [
    (1, "All", "3.5", "5.0", "4.0", "4.8", 0),
    (2, "All", "44", "147", "60", "100", 18),
    (3, "M", "0.7", "1.3", "0.8", "1.1", 18),
    (3, "F", "0.6", "1.1", "0.7", "0.9", 18),
    (4, "All", "70", "99", "80", "90", 0),
    (5, "All", "0", "3.0", "0", "1.0", 0),
    (6, "All", "4.5", "11.0", "5.0", "8.0", 0),
    (7, "All", "20", "40", "25", "35", 0),
    (8, "All", "82", "98", "85", "95", 0),
    (9, "All", "11.5", "14.5", "12.0", "13.5", 0),
]
# Biomarker id, sex, clinical min and max, longevity min and max.
_ETL_BOUNDS = [
    (1, "All", "3.5", "5.0", "4.0", "4.8"),
    (2, "All", "44", "147", "60", "120"),
    (3, "M", "0.74", "1.35", "0.80", "1.20"),
    (3, "F", "0.59", "1.04", "0.65", "1.00"),
    (4, "All", "74", "106", "80", "95"),
    (5, "All", "0.0", "3.0", "0.0", "1.0"),
    (6, "All", "3.5", "10.5", "4.5", "8.5"),
    (7, "All", "20", "45", "25", "40"),
    (8, "All", "80", "100", "85", "95"),
    (9, "All", "11.5", "14.5", "12.0", "14.0"),
]


def range_rows(range_set: str = "seed") -> list[tuple]:
    if range_set == "seed":
        clinical = [(b, "clinical", s, age, 200, lo, hi) for b, s, lo, hi, _, _, age in _SEED_BOUNDS]
        longevity = [(b, "longevity", s, age, 200, lo, hi) for b, s, _, _, lo, hi, age in _SEED_BOUNDS]
    elif range_set == "etl":
        clinical = [(b, "clinical", s, 18, 120, lo, hi) for b, s, lo, hi, _, _ in _ETL_BOUNDS]
        longevity = [(b, "longevity", s, 20, 30, lo, hi) for b, s, _, _, lo, hi in _ETL_BOUNDS]
    else:
        raise ValueError(f"unknown range set {range_set!r}")
    return clinical + longevity


_COLUMNS = {
    "biomarkers": "BiomarkerID INT, Name STRING, NHANESVarCode STRING, Units STRING, Description STRING",
    "models": "ModelID INT, ModelName STRING, Description STRING, FormulaJSON STRING",
    "coefficients": "ModelID INT, BiomarkerID INT, Coefficient DECIMAL(10,6), Transform STRING",
    "ranges": "BiomarkerID INT, RangeType STRING, Sex STRING, AgeMin INT, AgeMax INT,"
    " MinVal DECIMAL(12,4), MaxVal DECIMAL(12,4)",
}


def _columns(ddl: str) -> list[tuple[str, str]]:
    flat = ddl.replace("(12,4)", "(12;4)").replace("(10,6)", "(10;6)")
    return [tuple(part.strip().replace(";", ",").split(" ", 1)) for part in flat.split(",")]


def values_sql(rows: list[tuple], ddl: str) -> str:
    """SELECT over inline VALUES with the given column types; valid in Spark and in ANSI SQL."""
    columns = _columns(ddl)

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return str(value)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns))
    return f"SELECT {casts} FROM (VALUES {body}) AS v({names})"


def catalog_sql(table: str, range_set: str = "seed") -> str:
    rows = {
        "biomarkers": BIOMARKERS,
        "models": MODELS,
        "coefficients": COEFFICIENTS,
        "ranges": range_rows(range_set),
    }[table]
    return values_sql(rows, _COLUMNS[table])


def literal(spark: SparkSession, table: str, range_set: str = "seed") -> DataFrame:
    """A built-in catalog; none has more than a few dozen rows."""
    return F.broadcast(spark.sql(catalog_sql(table, range_set)))


def biomarkers(spark: SparkSession) -> DataFrame:
    return literal(spark, "biomarkers")


def models(spark: SparkSession) -> DataFrame:
    return literal(spark, "models")


def coefficients(spark: SparkSession) -> DataFrame:
    return literal(spark, "coefficients")


def ranges(spark: SparkSession, range_set: str = "seed") -> DataFrame:
    """``seed`` is the set shipped with the schema, ``etl`` the one the load step replaces it with."""
    return literal(spark, "ranges", range_set)
