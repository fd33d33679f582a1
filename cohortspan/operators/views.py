"""The five views: latest values, ranges, reference candidates, body measures, users with age.

None of them sorts: a sort over the whole population is only useful for output and is left to
the caller.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.functions.dates import calendar_years, full_years
from cohortspan.tables import Tables


def newest_per_group(df: DataFrame, keys: list[str], when: str) -> DataFrame:
    """Rows carrying the highest ``when`` of their group; ties stay.

    ``rank() = 1`` lets Spark keep only each map task's own candidates before the shuffle, so a
    group with very many rows arrives as a few. A window also reads its input once, where joining
    back on the maximum would read it twice. Rows without ``when`` sort last and never count.
    """
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last()))
    newest = (F.col("__rank") == 1) & F.col(when).isNotNull()
    return df.withColumn("__rank", rank).where(newest).drop("__rank")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Exactly one row per group, the first in ``order``."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__row", number).where("__row = 1").drop("__row")


def latest_measurements(t: Tables, users: DataFrame | None = None) -> DataFrame:
    """Latest value per user and biomarker; ``users`` (column UserID) limits whom to look at."""
    taken = t.measured().select("UserID", "BiomarkerID", "Value", "TakenAt")
    if users is not None:
        taken = taken.join(users.select("UserID").distinct(), "UserID", "left_semi")
    newest = newest_per_group(taken, ["UserID", "BiomarkerID"], "TakenAt")
    names = t.biomarkers.select("BiomarkerID", F.col("Name").alias("BiomarkerName"), "Units")
    return newest.join(names, "BiomarkerID").select(
        "UserID", "BiomarkerID", "Value", "TakenAt", "BiomarkerName", "Units"
    )


def biomarker_ranges(t: Tables) -> DataFrame:
    return t.biomarkers.join(t.ranges, "BiomarkerID", "left").select(
        "BiomarkerID", "Name", "Units", "RangeType", "Sex", "AgeMin", "AgeMax", "MinVal", "MaxVal"
    )


def hd_reference_candidates(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Young adults with a healthy body mass index, one row per body measurement."""
    age = calendar_years(F.col("BirthDate"), as_of)
    young = t.users.where(F.col("BirthDate").isNotNull()).withColumn("Age", age).where("Age BETWEEN 20 AND 30")
    healthy = t.anthropometry.where("BMI IS NOT NULL AND BMI >= 18.5 AND BMI < 30.0")
    return young.join(healthy, "UserID").select(
        "UserID", "SEQN", "Sex", "BMI", "HeightCM", "WeightKG", "ExamDate", "Age"
    )


def bmi_category(bmi: Column) -> Column:
    """A missing index falls through to the last class, as it does in the SQL this follows."""
    return (
        F.when(bmi < 18.5, "Underweight").when(bmi < 25.0, "Normal").when(bmi < 30.0, "Overweight").otherwise("Obese")
    )


def anthropometry_history(t: Tables) -> DataFrame:
    return (
        t.users.select("UserID", "SEQN")
        .join(t.anthropometry, "UserID")
        .select(
            "UserID", "SEQN", "ExamDate", "BMI", "HeightCM", "WeightKG", bmi_category(F.col("BMI")).alias("BMI_Category")
        )
    )


def users_with_age(t: Tables, as_of: dt.date | str) -> DataFrame:
    return t.users.select(
        "UserID", "SEQN", "BirthDate", "Sex", "RaceEthnicity", full_years(F.col("BirthDate"), as_of).alias("Age")
    )
