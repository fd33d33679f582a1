"""Numeric expressions shared by scores and chart series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspan.catalog import GLUCOSE

# Fixed value: mg/dL per mmol/L of glucose.
GLUCOSE_FACTOR = 18.0


def model_units(biomarker_id: Column, value: Column) -> Column:
    """Value in the unit the models expect: glucose in mmol/L, all others unchanged."""
    number = value.cast("double")
    return F.when(biomarker_id == GLUCOSE, number / GLUCOSE_FACTOR).otherwise(number)


def natural_log(value: Column) -> Column:
    """Natural logarithm, NULL where it is undefined."""
    return F.when(value > 0, F.ln(value))


def added(*terms: Column) -> Column:
    """Sum in the order given, so a double result does not depend on how rows are partitioned."""
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def axis_padding(low: Column, high: Column) -> Column:
    """Ten percent of the span; a flat series gets ten percent of its level, at least 0.5."""
    span = high - low
    return F.when(span == 0, F.greatest(F.abs(low) * 0.1, F.lit(0.5))).otherwise(span * 0.1)
