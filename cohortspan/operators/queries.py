"""The numbered queries, each for the whole population at once.

A question about one user is a filter on the result (``df.where("UserID = 7")``), which Catalyst
moves down to the scans. A user nobody knows gives no rows. Results are unordered unless the
position is part of the answer; sort one user's rows at the edge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.catalog import MODELS
from cohortspan.functions.dates import as_date, full_years, literal_days
from cohortspan.operators import intervals
from cohortspan.operators.views import first_per_group, latest_measurements, users_with_age
from cohortspan.tables import Tables

MODEL_NAMES = tuple(row[1] for row in MODELS)

# Age groups as the distribution query names them, with the first age not included.
AGE_GROUPS = [(30, "20-29"), (40, "30-39"), (50, "40-49")]
LAST_AGE_GROUP = "60+"
FULL_AGE_GROUPS = [(20, "0-19"), (30, "20-29"), (40, "30-39"), (50, "40-49"), (60, "50-59")]


def list_users(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 1. Visits are counted per user before the join, so a frequent visitor is one row in it."""
    visits = t.sessions.groupBy("UserID").agg(F.count("SessionID").alias("sessionCount"))
    return (
        users_with_age(t, as_of)
        .join(visits, "UserID", "left")
        .select(
            F.col("UserID").alias("userId"),
            F.col("SEQN").alias("seqn"),
            F.col("Age").alias("age"),
            F.col("Sex").alias("sex"),
            F.col("RaceEthnicity").alias("raceEthnicity"),
            F.coalesce(F.col("sessionCount"), F.lit(0)).alias("sessionCount"),
        )
    )


def user_profile(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 2, flat: user columns beside each latest value; users without values have one row."""
    return users_with_age(t, as_of).join(latest_measurements(t), "UserID", "left").select(
        F.col("UserID").alias("userId"),
        F.col("SEQN").alias("seqn"),
        F.col("BirthDate").alias("birthDate"),
        F.col("Sex").alias("sex"),
        F.col("RaceEthnicity").alias("raceEthnicity"),
        F.col("Age").alias("age"),
        F.col("BiomarkerID").alias("biomarkerId"),
        F.col("BiomarkerName").alias("name"),
        F.col("Value").alias("value"),
        F.col("Units").alias("units"),
        F.col("TakenAt").alias("takenAt"),
    )


def user_profile_nested(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 2, one row per user. The list holds latest values only, one per biomarker and tied visit,
    so its length is bounded by the catalog and not by how often a user was measured."""
    item = F.struct(
        F.col("BiomarkerID").alias("biomarkerId"),
        F.col("BiomarkerName").alias("name"),
        F.col("Value").alias("value"),
        F.col("Units").alias("units"),
        F.col("TakenAt").alias("takenAt"),
    )
    lists = latest_measurements(t).groupBy("UserID").agg(F.sort_array(F.collect_list(item)).alias("biomarkers"))
    user = F.struct(
        F.col("UserID").alias("userId"),
        F.col("SEQN").alias("seqn"),
        F.col("BirthDate").alias("birthDate"),
        F.col("Sex").alias("sex"),
        F.col("RaceEthnicity").alias("raceEthnicity"),
        F.col("Age").alias("age"),
    )
    return users_with_age(t, as_of).join(lists, "UserID", "left").select("UserID", user.alias("user"), "biomarkers")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _dated_results(t: Tables, as_of: dt.date | str, results: DataFrame) -> DataFrame:
    ages = t.users.select("UserID", full_years(F.col("BirthDate"), as_of).alias("Age"))
    gap = (F.col("BioAgeYears") - F.col("Age")).cast("decimal(8,2)")
    return (
        results.join(t.models.select("ModelID", "ModelName"), "ModelID")
        .join(ages, "UserID")
        .select(
            F.col("UserID").alias("userId"),
            F.col("ModelID").alias("modelId"),
            F.col("ModelName").alias("modelName"),
            F.col("BioAgeYears").alias("bioAgeYears"),
            gap.alias("ageGap"),
            F.col("ComputedAt").alias("computedAt"),
        )
    )


def bio_age(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 3: all stored results of every user with the gap to the age now."""
    return _dated_results(t, as_of, t.results)


def bio_age_latest(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 3 as its title promises: the newest result per user and model."""
    newest = first_per_group(t.results, ["UserID", "ModelID"], [F.col("ComputedAt").desc(), F.col("BioAgeYears").desc()])
    return _dated_results(t, as_of, newest)


def bio_age_history(t: Tables, as_of: dt.date | str, model: str | None = None) -> DataFrame:
    """Query 7; a model name nobody knows is ignored."""
    models = t.models.where(F.col("ModelName") == model) if model in MODEL_NAMES else t.models
    return _dated_results(t.replace(models=models), as_of, t.results)


def range_status(hits: Column) -> Column:
    """In both ranges, in one, in none. More than two hits, from tied values, count as none."""
    return F.when(hits == 2, "Optimal").when(hits == 1, "Normal").otherwise("OutOfRange")


def range_comparison(
    t: Tables, as_of: dt.date | str | None = None, match_age: bool = False, only: str | None = None
) -> DataFrame:
    """Query 5: latest values against the clinical and longevity ranges for the user's sex.

    ``match_age`` also asks the user's age to lie within the range's ages; ranges are then looked up as elementary
    intervals. ``only`` keeps one range type, and rows that have such a range. Without ages a biomarker has a few
    ranges, which are broadcast, so the rest is one join with users and one aggregation on the same key.
    """
    people = t.users.select("UserID", F.col("Sex").alias("UserSex"), "BirthDate")
    if match_age:
        people = people.withColumn("Age", full_years(F.col("BirthDate"), as_of))
    people = people.drop("BirthDate")
    latest = latest_measurements(t).join(people, "UserID")
    kinds = ("clinical", "longevity")
    if match_age:
        placed = intervals.looked_up(latest, t.ranges)
    else:
        ranges = t.ranges.withColumnRenamed("BiomarkerID", "RangeBiomarkerID")
        fits = (F.col("BiomarkerID") == F.col("RangeBiomarkerID")) & (
            (F.col("Sex") == "All") | (F.col("Sex") == F.col("UserSex"))
        )
        inside = (F.col("MinVal") <= F.col("Value")) & (F.col("Value") <= F.col("MaxVal"))
        placed = latest.join(ranges, fits).select(
            "*",
            F.when(inside, 1).otherwise(0).alias("hits"),
            *[F.when(F.col("RangeType") == kind, F.struct("MinVal", "MaxVal")).alias(kind) for kind in kinds],
        )
    compared = placed.groupBy("UserID", "BiomarkerID", "BiomarkerName", "Value").agg(
        F.sum("hits").alias("hits"), *[F.max(kind).alias(kind) for kind in kinds]
    )
    base = [
        F.col("UserID").alias("userId"),
        F.col("BiomarkerID").alias("biomarkerId"),
        F.col("BiomarkerName").alias("name"),
        F.col("Value").alias("value"),
        range_status(F.col("hits")).alias("status"),
    ]
    if only:
        return compared.where(F.col(only).isNotNull()).select(
            *base, F.col(f"{only}.MinVal").alias("rangeMin"), F.col(f"{only}.MaxVal").alias("rangeMax")
        )
    return compared.select(
        *base,
        F.col("clinical.MinVal").alias("clinicalMin"),
        F.col("clinical.MaxVal").alias("clinicalMax"),
        F.col("longevity.MinVal").alias("longevityMin"),
        F.col("longevity.MaxVal").alias("longevityMax"),
    )


def ranges_as_json(compared: DataFrame) -> DataFrame:
    """The two ranges as JSON text, the form in which they leave the system."""

    def text(kind: str) -> Column:
        low, high = F.col(f"{kind}Min"), F.col(f"{kind}Max")
        return F.when(low.isNotNull() | high.isNotNull(), F.to_json(F.struct(low.alias("min"), high.alias("max"))))

    return compared.select(
        "userId",
        "biomarkerId",
        "name",
        "value",
        "status",
        text("clinical").alias("clinicalRange"),
        text("longevity").alias("longevityRange"),
    )


def trend(t: Tables, as_of: dt.date | str, limit: int = 20, within: str = "6months") -> DataFrame:
    """Query 6: the newest ``limit`` values per user and biomarker after the start of the period.

    The day the period starts on does not belong to it. Raises for a text that is no duration.
    """
    days = literal_days(within)
    if days is None:
        raise ValueError("period must be '<number> <days|weeks|months|years>'")
    cutoff = F.date_sub(as_date(as_of), F.lit(days).cast("int"))
    points = t.measured().where(F.col("SessionDate") > cutoff)
    points = points.select("UserID", "SessionID", "SessionDate", "BiomarkerID", "Value")
    number = F.row_number().over(
        Window.partitionBy("UserID", "BiomarkerID").orderBy(F.col("SessionDate").desc(), F.col("SessionID").desc())
    )
    return (
        points.withColumn("n", number)
        .where(F.col("n") <= limit)
        .select(
            F.col("UserID").alias("userId"),
            F.col("BiomarkerID").alias("biomarkerId"),
            F.col("SessionDate").alias("date"),
            F.col("Value").alias("value"),
            F.col("SessionID").alias("sessionId"),
        )
    )


def session_details(t: Tables) -> DataFrame:
    """Query 8, flat: every value with its visit, name and unit."""
    return (
        t.sessions.join(t.measurements, "SessionID")
        .join(t.biomarkers, "BiomarkerID")
        .select(
            F.col("UserID").alias("userId"),
            F.col("SessionID").alias("sessionId"),
            F.col("SessionDate").alias("sessionDate"),
            F.col("FastingStatus").alias("fastingStatus"),
            F.col("BiomarkerID").alias("biomarkerId"),
            F.col("Name").alias("name"),
            F.col("Value").alias("value"),
            F.col("Units").alias("units"),
        )
    )


def session_details_nested(t: Tables) -> DataFrame:
    """Query 8, one row per visit. The natural key of measurements allows one value per biomarker, so a
    list is never longer than the catalog."""
    item = F.struct("biomarkerId", "name", "value", "units")
    return (
        session_details(t)
        .groupBy("userId", "sessionId", "sessionDate", "fastingStatus")
        .agg(F.sort_array(F.collect_list(item)).alias("measurements"))
    )


def user_sessions(t: Tables) -> DataFrame:
    """Query 8.5."""
    return t.sessions.select(
        F.col("UserID").alias("userId"),
        F.col("SessionID").alias("sessionId"),
        F.col("SessionDate").alias("sessionDate"),
        F.col("FastingStatus").alias("fastingStatus"),
    )


def biomarker_catalog(t: Tables) -> DataFrame:
    """Query 9."""
    return t.biomarkers.select(
        F.col("BiomarkerID").alias("biomarkerId"),
        F.col("Name").alias("name"),
        F.col("Units").alias("units"),
        F.col("Description").alias("description"),
        F.col("NHANESVarCode").alias("nhanesVarCode"),
    )


def ranges_of_biomarkers(t: Tables) -> DataFrame:
    """Query 10."""
    return t.ranges.select(
        F.col("BiomarkerID").alias("biomarkerId"),
        F.col("RangeType").alias("rangeType"),
        F.col("Sex").alias("sex"),
        F.col("AgeMin").alias("ageMin"),
        F.col("AgeMax").alias("ageMax"),
        F.col("MinVal").alias("minVal"),
        F.col("MaxVal").alias("maxVal"),
    )


def age_distribution(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 11 with its own groups: the youngest join 20-29, from 50 on and unknown ages 60+."""
    age = full_years(F.col("BirthDate"), as_of)
    group = F.coalesce(*[F.when(age < below, label) for below, label in AGE_GROUPS], F.lit(LAST_AGE_GROUP))
    return t.users.groupBy(group.alias("AgeGroup"), "Sex").agg(F.count(F.lit(1)).alias("UserCount"))


def sex_order(sex: Column) -> Column:
    """Sort key of an enumerated sex: NULL, M, F."""
    return F.when(sex == "M", 1).when(sex == "F", 2).otherwise(0)


def age_distribution_rollup(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Query 11 with all ten-year groups, and subtotals per group and over all users."""
    age = full_years(F.col("BirthDate"), as_of)
    group = F.when(age.isNull(), "unknown").otherwise(
        F.coalesce(*[F.when(age < below, label) for below, label in FULL_AGE_GROUPS], F.lit(LAST_AGE_GROUP))
    )
    people = t.users.select(group.alias("AgeGroup"), "Sex")
    return people.rollup("AgeGroup", "Sex").agg(
        F.grouping_id().cast("int").alias("Level"), F.count(F.lit(1)).alias("UserCount")
    )


def measurement_counts(t: Tables) -> DataFrame:
    """Values per biomarker: the one-row-per-biomarker form in which facts meet the catalogs."""
    return t.measurements.groupBy("BiomarkerID").agg(F.count(F.lit(1)).alias("MeasurementCount"))


def measurement_summary(t: Tables) -> DataFrame:
    """Query 12. Counted before names are joined; names need not be unique, so they are grouped after."""
    return (
        t.biomarkers.join(measurement_counts(t), "BiomarkerID", "left")
        .groupBy("Name", "Units")
        .agg(F.coalesce(F.sum("MeasurementCount"), F.lit(0)).alias("MeasurementCount"))
    )


def demo_user_counts(t: Tables, first_seqn: int | None = None, last_seqn: int | None = None) -> DataFrame:
    """Visits and distinct biomarkers per user, for all users or a range of participant numbers."""
    users = t.users
    if first_seqn is not None:
        users = users.where(F.col("SEQN").between(first_seqn, last_seqn))
    visits = t.sessions.groupBy("UserID").agg(F.count("SessionID").alias("Sessions"))
    measured = (
        t.measurements.select("SessionID", "BiomarkerID")
        .join(t.sessions.select("SessionID", "UserID"), "SessionID")
        .groupBy("UserID")
        .agg(F.countDistinct("BiomarkerID").alias("Biomarkers"))
    )
    return (
        users.select("UserID", "SEQN")
        .join(visits, "UserID", "left")
        .join(measured, "UserID", "left")
        .select(
            "UserID",
            "SEQN",
            F.coalesce(F.col("Sessions"), F.lit(0)).alias("Sessions"),
            F.coalesce(F.col("Biomarkers"), F.lit(0)).alias("Biomarkers"),
        )
    )


def model_metadata(t: Tables) -> DataFrame:
    """Fields of the models' JSON metadata."""

    def field(name: str) -> Column:
        return F.get_json_object("FormulaJSON", f"$.{name}")

    return t.models.select(
        "ModelID",
        "ModelName",
        field("algorithm").alias("algorithm"),
        field("pmid").alias("pmid"),
        field("intercept").cast("double").alias("intercept"),
        field("age_coef").cast("double").alias("ageCoefficient"),
        field("biomarkers").cast("int").alias("biomarkers"),
    )
