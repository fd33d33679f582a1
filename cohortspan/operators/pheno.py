"""Phenotypic age: a nine-biomarker regression passed through a mortality transform."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.catalog import PHENOTYPIC_AGE
from cohortspan.functions.dates import full_years
from cohortspan.functions.numbers import added, model_units, natural_log
from cohortspan.operators.views import latest_measurements
from cohortspan.tables import Tables

# Fixed values of the published model.
AGE_COEFFICIENT = 0.0804
INTERCEPT = -19.9067
MAX_MORTALITY = 0.999999
AGE_OFFSET = 141.50
AGE_SCALE = 0.09165
BIOMARKER_IDS = tuple(range(1, 10))

STATUS_OK = "ok"
STATUS_INSUFFICIENT = "insufficient_biomarkers"
STATUS_INVALID = "invalid_value"


def weighted(latest: DataFrame, coefficients: DataFrame, how: str = "inner") -> DataFrame:
    """Latest values with ``Term``, the transformed value times its coefficient.

    A left join also keeps biomarkers the model has no coefficient for, without a term.
    """
    weights = coefficients.where(F.col("ModelID") == PHENOTYPIC_AGE).select(
        "BiomarkerID", F.col("Coefficient").cast("double").alias("Coefficient"), "Transform"
    )
    unit = model_units(F.col("BiomarkerID"), F.col("Value"))
    shaped = F.when(F.col("Transform") == "log", natural_log(unit)).otherwise(unit)
    joined = latest.select("UserID", "BiomarkerID", "Value").join(weights, "BiomarkerID", how)
    return joined.select("UserID", "BiomarkerID", "Value", (shaped * F.col("Coefficient")).alias("Term"))


def terms(latest: DataFrame, coefficients: DataFrame) -> DataFrame:
    """One row per latest value of the model's biomarkers."""
    return weighted(latest, coefficients).drop("Value")


def term_slots() -> list[Column]:
    """Aggregations that put each biomarker's term into a column of its own."""
    return [F.max(F.when(F.col("BiomarkerID") == i, F.col("Term"))).alias(f"t{i}") for i in BIOMARKER_IDS]


def slot_sum() -> Column:
    """Sum of the slots in the order of the biomarkers; NULL if one is missing."""
    return added(*[F.col(f"t{i}") for i in BIOMARKER_IDS])


def linear(latest: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Sum of the terms per user and the number of latest rows of the user.

    The sum is NULL if a biomarker is missing or its logarithm does not exist.
    """
    per_user = weighted(latest, coefficients, "left").groupBy("UserID")
    slots = per_user.agg(F.count(F.lit(1)).alias("BiomarkerCount"), *term_slots())
    return slots.select("UserID", "BiomarkerCount", slot_sum().alias("LinearTerm"))


def mortality_score(linear_term: Column, age: Column) -> Column:
    return linear_term + age * F.lit(AGE_COEFFICIENT) + F.lit(INTERCEPT)


def age_from_mortality(score: Column) -> Column:
    """Age at which the mortality risk is usual; NULL where the risk underflows to zero.

    The cap is a CASE, since LEAST would pass over a NULL score and return the cap.
    """
    risk = 1 - F.exp(-F.exp(score))
    risk = F.when(risk > MAX_MORTALITY, F.lit(MAX_MORTALITY)).otherwise(risk)
    return F.round(F.lit(AGE_OFFSET) + natural_log(-natural_log(1 - risk)) / F.lit(AGE_SCALE), 2)


def phenotypic_age(t: Tables, as_of: dt.date | str, sums: DataFrame | None = None) -> DataFrame:
    """Score, gap and status of every user; users without exactly nine latest rows get no score.

    ``sums`` is what ``linear`` returns, if it is at hand.
    """
    sums = linear(latest_measurements(t), t.coefficients) if sums is None else sums
    age = full_years(F.col("BirthDate"), as_of)
    scored = (
        t.users.select("UserID", age.alias("Age"))
        .join(sums, "UserID", "left")
        .withColumn("Complete", F.coalesce(F.col("BiomarkerCount"), F.lit(0)) == len(BIOMARKER_IDS))
        .withColumn(
            "BioAgeYears",
            F.when(F.col("Complete"), age_from_mortality(mortality_score(F.col("LinearTerm"), F.col("Age")))),
        )
    )
    status = (
        F.when(~F.col("Complete"), STATUS_INSUFFICIENT)
        .when(F.col("BioAgeYears").isNull(), STATUS_INVALID)
        .otherwise(STATUS_OK)
    )
    return scored.select(
        "UserID",
        "Age",
        "BioAgeYears",
        F.round(F.col("BioAgeYears") - F.col("Age"), 2).alias("AgeGap"),
        status.alias("Status"),
    )
