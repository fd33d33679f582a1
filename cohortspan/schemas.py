"""Table schemas, natural keys and references of the health data model."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _STR, _DATE, _TS, _BOOL = (
    T.IntegerType(),
    T.StringType(),
    T.DateType(),
    T.TimestampType(),
    T.BooleanType(),
)


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


USER = _table(
    ("UserID", _INT, False),
    ("SEQN", _INT, True),
    ("BirthDate", _DATE, True),
    ("Sex", _STR, True),
    ("RaceEthnicity", _STR, True),
)
SESSION = _table(
    ("SessionID", _INT, False),
    ("UserID", _INT, False),
    ("SessionDate", _DATE, False),
    ("FastingStatus", _BOOL, True),
)
BIOMARKER = _table(
    ("BiomarkerID", _INT, False),
    ("Name", _STR, False),
    ("NHANESVarCode", _STR, True),
    ("Units", _STR, False),
    ("Description", _STR, True),
)
MEASUREMENT = _table(
    ("SessionID", _INT, False),
    ("BiomarkerID", _INT, False),
    ("Value", T.DecimalType(12, 4), False),
    ("TakenAt", _TS, False),
)
ANTHROPOMETRY = _table(
    ("UserID", _INT, False),
    ("ExamDate", _DATE, False),
    ("HeightCM", T.DecimalType(5, 2), True),
    ("WeightKG", T.DecimalType(5, 2), True),
    ("BMI", T.DecimalType(4, 2), True),
)
RANGE = _table(
    ("BiomarkerID", _INT, False),
    ("RangeType", _STR, False),
    ("Sex", _STR, True),
    ("AgeMin", _INT, True),
    ("AgeMax", _INT, True),
    ("MinVal", T.DecimalType(12, 4), True),
    ("MaxVal", T.DecimalType(12, 4), True),
)
MODEL = _table(
    ("ModelID", _INT, False),
    ("ModelName", _STR, True),
    ("Description", _STR, True),
    ("FormulaJSON", _STR, True),
)
COEFFICIENT = _table(
    ("ModelID", _INT, False),
    ("BiomarkerID", _INT, False),
    ("Coefficient", T.DecimalType(10, 6), True),
    ("Transform", _STR, True),
)
RESULT = _table(
    ("UserID", _INT, False),
    ("ModelID", _INT, False),
    ("BioAgeYears", T.DecimalType(5, 2), False),
    ("ComputedAt", _TS, False),
)

# How measurements are stored: with the user and day of their visit.
MEASURED = T.StructType(
    [*MEASUREMENT.fields, T.StructField("UserID", _INT, True), T.StructField("SessionDate", _DATE, True)]
)

SCHEMAS = {
    "users": USER,
    "sessions": SESSION,
    "biomarkers": BIOMARKER,
    "measurements": MEASUREMENT,
    "anthropometry": ANTHROPOMETRY,
    "ranges": RANGE,
    "models": MODEL,
    "coefficients": COEFFICIENT,
    "results": RESULT,
}

# Rows of these tables have an id beside their natural key; the others are named by a column of theirs or by their key.
RECORD_IDS = {"measurements": "MeasurementID", "anthropometry": "AnthroID", "ranges": "RangeID", "results": "ResultID"}
# When a row was stored.
CREATED = "CreatedAt"
# The full data model: the columns above with the id of the row before them and its time behind them.
RECORDS = {
    name: T.StructType(
        [
            *([T.StructField(RECORD_IDS[name], T.LongType(), True)] if name in RECORD_IDS else []),
            *schema.fields,
            T.StructField(CREATED, _TS, True),
        ]
    )
    for name, schema in SCHEMAS.items()
}

# Tables that hold definitions, not observations.
CATALOGS = ("biomarkers", "ranges", "models", "coefficients")

# Natural keys: what a load or an upsert matches on.
NATURAL_KEYS = {
    "users": ["SEQN"],
    "sessions": ["UserID", "SessionDate"],
    "biomarkers": ["NHANESVarCode"],
    "measurements": ["SessionID", "BiomarkerID"],
    "anthropometry": ["UserID", "ExamDate"],
    "ranges": ["BiomarkerID", "RangeType", "Sex", "AgeMin", "AgeMax"],
    "models": ["ModelName"],
    "coefficients": ["ModelID", "BiomarkerID"],
    "results": ["UserID", "ModelID", "ComputedAt"],
}

# name, child table, column, parent table
REFERENCES = [
    ("fk_session_user", "sessions", "UserID", "users"),
    ("fk_measurement_session", "measurements", "SessionID", "sessions"),
    ("fk_measurement_biomarker", "measurements", "BiomarkerID", "biomarkers"),
    ("fk_anthro_user", "anthropometry", "UserID", "users"),
    ("fk_range_biomarker", "ranges", "BiomarkerID", "biomarkers"),
    ("fk_model_uses_model", "coefficients", "ModelID", "models"),
    ("fk_model_uses_biomarker", "coefficients", "BiomarkerID", "biomarkers"),
    ("fk_bio_age_user", "results", "UserID", "users"),
    ("fk_bio_age_model", "results", "ModelID", "models"),
]

# Values an enumerated column may hold.
DOMAINS = {
    ("users", "Sex"): ["M", "F"],
    ("ranges", "RangeType"): ["clinical", "longevity"],
    ("ranges", "Sex"): ["M", "F", "All"],
}
