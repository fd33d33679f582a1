"""Biological ages of the whole population by both models, and storing them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.catalog import MODELS, PHENOTYPIC_AGE
from cohortspan.functions.dates import full_years
from cohortspan.operators import hd, pheno
from cohortspan.operators.views import latest_measurements
from cohortspan.session import cut_lineage
from cohortspan.tables import Tables

STATUS_NO_MODEL = "hd_unavailable"
STATUS_TOO_LARGE = "value_out_of_range"
MODEL_IDS = {name: number for number, name, _, _ in MODELS}


def scoring_inputs(t: Tables) -> DataFrame:
    """One row per user with what both models need: regression sum and biomarkers as columns."""
    per_user = pheno.weighted(latest_measurements(t), t.coefficients, "left").groupBy("UserID")
    cells = per_user.agg(F.count(F.lit(1)).alias("BiomarkerCount"), *pheno.term_slots(), *hd.value_cells())
    return cells.select(
        "UserID", "BiomarkerCount", pheno.slot_sum().alias("LinearTerm"), *[f"`{name}`" for name in hd.NAMES]
    )


def hd_age(t: Tables, as_of: dt.date | str, model: hd.HDModel | None, wide: DataFrame | None = None) -> DataFrame:
    """Distance turned into an age for every user; without a model all users get that status.

    ``wide`` is what ``hd.wide_values`` returns, if it is at hand.
    """
    wide = hd.wide_values(latest_measurements(t)) if wide is None else wide
    people = t.users.select("UserID", full_years(F.col("BirthDate"), as_of).alias("Age"))
    joined = people.join(wide, "UserID", "left")
    complete = F.coalesce(F.col("BiomarkerCount"), F.lit(0)) == len(hd.IDS)
    distance = F.lit(None).cast("double") if model is None else model.distance()
    scored = joined.withColumn("Complete", complete).withColumn(
        "BioAgeYears", F.when(F.col("Complete"), hd.age_from_distance(F.col("Age"), distance))
    )
    status = F.when(~F.col("Complete"), pheno.STATUS_INSUFFICIENT)
    if model is None:
        status = status.otherwise(STATUS_NO_MODEL)
    else:
        status = status.when(F.col("BioAgeYears").isNull(), pheno.STATUS_INVALID).otherwise(pheno.STATUS_OK)
    return scored.select(
        "UserID",
        "Age",
        "BioAgeYears",
        F.round(F.col("BioAgeYears") - F.col("Age"), 2).alias("AgeGap"),
        status.alias("Status"),
    )


def calculate(
    t: Tables,
    as_of: dt.date | str,
    model_name: str = "",
    strict: bool = False,
    min_rows: int = hd.MIN_REFERENCE_ROWS,
    computed_at: str | None = None,
) -> DataFrame:
    """Scores by one model, or by both if no name is given, with a status per user and model.

    ``computed_at`` adds the time of the request to the answer as ``ComputedAt``. ``strict`` makes a user's request all-or-nothing: one failing model withdraws the other score.
    Both models and the fit read one row per user, which is stored once.
    """
    if model_name and model_name not in MODEL_IDS:
        raise ValueError(f"invalid model {model_name!r}")
    wanted = [model_name] if model_name else list(MODEL_IDS)
    inputs = cut_lineage(scoring_inputs(t), "scoring-inputs")
    parts = []
    for name in wanted:
        if MODEL_IDS[name] == PHENOTYPIC_AGE:
            scored = pheno.phenotypic_age(t, as_of, inputs.select("UserID", "BiomarkerCount", "LinearTerm"))
        else:
            try:
                model = hd.fit(hd.reference_wide(t, as_of, inputs), age_column=None, min_rows=min_rows)
            except hd.HDUnavailable:
                model = None
            scored = hd_age(t, as_of, model, inputs.drop("LinearTerm"))
        parts.append(scored.withColumn("ModelID", F.lit(MODEL_IDS[name])).withColumn("ModelName", F.lit(name)))
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    unfit = F.col("BioAgeYears").isNotNull() & F.col("BioAgeYears").try_cast("decimal(5,2)").isNull()
    result = result.withColumn("Status", F.when(unfit, STATUS_TOO_LARGE).otherwise(F.col("Status")))
    if strict:
        failed = result.where(F.col("Status") != pheno.STATUS_OK).select("UserID").distinct()
        withdrawn = failed.withColumn("Withdrawn", F.lit(True))
        kept = F.col("Withdrawn").isNull()
        result = (
            result.join(withdrawn, "UserID", "left")
            .withColumn("BioAgeYears", F.when(kept, F.col("BioAgeYears")))
            .withColumn("AgeGap", F.when(kept, F.col("AgeGap")))
            .drop("Withdrawn")
        )
    time = [] if computed_at is None else [F.lit(computed_at).cast("timestamp").alias("ComputedAt")]
    return result.select("UserID", "ModelID", "ModelName", "Age", "BioAgeYears", "AgeGap", "Status", *time)


def new_results(scores: DataFrame, computed_at: str, existing: DataFrame) -> DataFrame:
    """Rows to append to the stored results: scored, and not stored under the same key yet.

    A score that does not fit the column cannot be stored; ``calculate`` gives it the status
    ``value_out_of_range``. Of several scores with one key the highest is taken.
    """
    rows = scores.select(
        "UserID",
        "ModelID",
        F.col("BioAgeYears").try_cast("decimal(5,2)").alias("BioAgeYears"),
        F.lit(computed_at).cast("timestamp").alias("ComputedAt"),
    )
    keys = ["UserID", "ModelID", "ComputedAt"]
    # Reduced in every task before the shuffle; the join then meets each key once.
    rows = rows.where("BioAgeYears IS NOT NULL").groupBy(*keys).agg(F.max("BioAgeYears").alias("BioAgeYears"))
    rows = rows.select("UserID", "ModelID", "BioAgeYears", "ComputedAt")
    return rows.join(existing.select(*keys), keys, "left_anti")


def append_results(scores: DataFrame, computed_at: str, folder: str) -> None:
    """Append new scores to the parquet results in ``folder``; running it again adds nothing."""
    existing = scores.sparkSession.read.parquet(folder)
    new_results(scores, computed_at, existing).write.mode("append").parquet(folder)

