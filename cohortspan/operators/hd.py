"""Homeostatic dysregulation: Mahalanobis distance from a healthy young reference population.

The fit is one aggregation that brings one row to the driver, moments and covariances; the matrix of the
few biomarkers is inverted there. Scoring is plain column arithmetic with the fitted numbers as literals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cohortspan.catalog import BIOMARKERS
from cohortspan.functions.numbers import added, model_units
from cohortspan.operators.views import hd_reference_candidates, latest_measurements
from cohortspan.session import cut_lineage
from cohortspan.tables import Tables

# Smallest reference population, and how a distance turns into an age.
MIN_REFERENCE_ROWS = 20
TYPICAL_DISTANCE = 2.5
YEARS_PER_UNIT = 4

NAMES = tuple(row[1] for row in BIOMARKERS)
IDS = tuple(row[0] for row in BIOMARKERS)


class HDUnavailable(ValueError):
    """The reference population cannot carry a model."""


@dataclass(frozen=True)
class HDModel:
    names: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]
    rows: int
    slope: float | None = None
    intercept: float | None = None

    def z(self, i: int) -> Column:
        return (F.col(f"`{self.names[i]}`") - F.lit(self.means[i])) / F.lit(self.stds[i])

    def distance(self) -> Column:
        """Square root of the quadratic form, written out; NULL if a biomarker is missing."""
        p = len(self.names)
        z = [self.z(i) for i in range(p)]
        rows = []
        for i in range(p):
            mixed = [z[j] * F.lit(2 * self.precision[i][j]) for j in range(i + 1, p)]
            rows.append(z[i] * added(z[i] * F.lit(self.precision[i][i]), *mixed))
        square = added(*rows)
        return F.sqrt(F.when(square < 0, F.lit(0.0)).otherwise(square))

    def years(self, distance: Column) -> Column:
        if self.slope is None:
            return F.lit(None).cast("double")
        return F.lit(self.slope) * distance + F.lit(self.intercept)


def value_cells() -> list[Column]:
    """Aggregations that put each biomarker into a column, in model units; tied values are averaged."""
    value = model_units(F.col("BiomarkerID"), F.col("Value"))
    return [F.avg(F.when(F.col("BiomarkerID") == i, value)).alias(name) for i, name in zip(IDS, NAMES)]


def wide_values(latest: DataFrame) -> DataFrame:
    """One row per user: the number of latest rows, and a column per biomarker."""
    return latest.groupBy("UserID").agg(F.count(F.lit(1)).alias("BiomarkerCount"), *value_cells())


def reference_wide(t: Tables, as_of: dt.date | str, wide: DataFrame | None = None) -> DataFrame:
    """Complete rows of the reference population.

    A user enters once per distinct body mass index. Values are pivoted per user first, so several
    body measurements do not multiply the long table. ``wide`` is what ``wide_values`` returns, if it
    is at hand; else only the candidates' measurements are looked at.
    """
    people = hd_reference_candidates(t, as_of).select("UserID", "Age", "BMI", "Sex").dropna().distinct()
    if wide is None:
        wide = wide_values(latest_measurements(t, people.select("UserID")))
    complete = wide.select("UserID", *[f"`{name}`" for name in NAMES]).dropna()
    return people.join(complete, "UserID").select(
        "UserID", "Age", F.col("BMI").cast("double").alias("BMI"), "Sex", *[f"`{name}`" for name in NAMES]
    )


def _moment_columns(names: Sequence[str]) -> list[Column]:
    columns = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        value = F.col(f"`{name}`").cast("double")
        columns += [F.avg(value).alias(f"mean_{i}"), F.stddev_samp(value).alias(f"std_{i}")]
    return columns


def moments(reference: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """Mean and sample standard deviation, one row per biomarker."""
    flat = reference.agg(*_moment_columns(names))
    cells = [
        F.struct(F.lit(name).alias("Biomarker"), F.col(f"mean_{i}").alias("Mean"), F.col(f"std_{i}").alias("Std"))
        for i, name in enumerate(names)
    ]
    return flat.select("n", F.explode(F.array(*cells)).alias("m")).select("m.*", F.col("n").alias("ReferenceRows"))


def _pairs(count: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(count) for j in range(i + 1, count)]


def _covariance_columns(names: Sequence[str]) -> list[Column]:
    """Covariance of every pair; its running form is centred, so large means do not cancel."""
    value = [F.col(f"`{name}`").cast("double") for name in names]
    return [F.covar_samp(value[i], value[j]).alias(f"p_{i}_{j}") for i, j in _pairs(len(value))]


def _standardise(row: Row | dict, names: tuple[str, ...], min_rows: int) -> HDModel:
    """Means and deviations as a model that has no precision matrix yet."""
    if row["n"] < max(min_rows, 2):
        raise HDUnavailable(f"reference population too small: {row['n']} < {min_rows}")
    stds = tuple(float(row[f"std_{i}"]) for i in range(len(names)))
    if not all(np.isfinite(stds)) or min(stds) <= 0:
        raise HDUnavailable("a biomarker does not vary in the reference population")
    means = tuple(float(row[f"mean_{i}"]) for i in range(len(names)))
    return HDModel(names=names, means=means, stds=stds, precision=(), rows=int(row["n"]))


def correlation(reference: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """Correlation of every pair of biomarkers, which is the covariance of the z-scores."""
    flat = reference.agg(*_moment_columns(names), *_covariance_columns(names))
    cells = [
        F.struct(
            F.lit(names[i]).alias("BiomarkerA"),
            F.lit(names[j]).alias("BiomarkerB"),
            (F.col(f"p_{i}_{j}") / (F.col(f"std_{i}") * F.col(f"std_{j}"))).alias("Correlation"),
        )
        for i, j in _pairs(len(names))
    ]
    return flat.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def from_moments(row: Row | dict, names: tuple[str, ...], min_rows: int) -> HDModel:
    """The model without a regression from count, means, deviations and covariances, named as ``fit`` names them."""
    model = _standardise(row, names, min_rows)
    matrix = np.eye(len(names))
    for i, j in _pairs(len(names)):
        matrix[i, j] = matrix[j, i] = row[f"p_{i}_{j}"] / (model.stds[i] * model.stds[j])
    if np.linalg.matrix_rank(matrix) < len(names):
        raise HDUnavailable("the correlation matrix of the reference population is singular")
    return replace(model, precision=tuple(tuple(float(v) for v in line) for line in np.linalg.inv(matrix)))


def fit(
    reference: DataFrame,
    names: Sequence[str] = NAMES,
    age_column: str | None = "Age",
    min_rows: int = MIN_REFERENCE_ROWS,
) -> HDModel:
    """Fit the model; with ``age_column`` also the regression of the distance on age.

    One aggregation gives counts, means, deviations and all covariances. With the regression ``reference`` is
    read a second time: store it before if it is costly.
    """
    complete = reference.dropna(subset=list(names))
    row = complete.agg(*_moment_columns(names), *_covariance_columns(names)).first()
    model = from_moments(row, tuple(names), min_rows)
    if age_column is None or age_column not in reference.columns:
        return model
    line = age_regression(complete, model, age_column).first()
    return replace(model, slope=line["Slope"], intercept=line["Intercept"])


def age_regression(reference: DataFrame, model: HDModel, age_column: str = "Age") -> DataFrame:
    """Ordinary least squares of the distance on age over the reference population."""
    points = reference.select(F.col(age_column).cast("double").alias("age"), model.distance().alias("d"))
    return points.agg(F.regr_slope("d", "age").alias("Slope"), F.regr_intercept("d", "age").alias("Intercept"))


def precision_rows(model: HDModel) -> list[tuple[str, str, float]]:
    """The inverse matrix as rows."""
    return [
        (a, b, model.precision[i][j]) for i, a in enumerate(model.names) for j, b in enumerate(model.names)
    ]


def batch(wide: DataFrame, model: HDModel, convert_to_years: bool = True) -> DataFrame:
    """Add ``HD_score`` and, on request, ``HD_years``; a missing value gives NULL."""
    absent = sorted(set(model.names) - set(wide.columns))
    if absent:
        raise ValueError(f"missing biomarker columns: {absent}")
    scored = wide.withColumn("HD_score", model.distance())
    return scored.withColumn("HD_years", model.years(F.col("HD_score"))) if convert_to_years else scored


def fit_and_score(wide: DataFrame, reference: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """Fit on ``reference`` and score ``wide`` in one call; rows must be complete."""
    return batch(wide.dropna(subset=list(names)), fit(reference, names))


def fit_population(t: Tables, as_of: dt.date | str, with_years: bool = True) -> HDModel:
    """Model of the population's own reference group.

    The fit reads the reference rows several times, so they are stored once in between.
    """
    reference = cut_lineage(reference_wide(t, as_of), "reference")
    return fit(reference, age_column="Age" if with_years else None)


def age_from_distance(age: Column, distance: Column) -> Column:
    return F.round(age + (distance - F.lit(TYPICAL_DISTANCE)) * F.lit(YEARS_PER_UNIT), 2)
