"""Tables behind the charts: series, axis domains, bands and markers, for all users at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.dates import iso_date
from cohortspan.functions.numbers import axis_padding
from cohortspan.functions.ordinals import dense_ordinal
from cohortspan.operators.queries import bio_age_history
from cohortspan.operators.views import first_per_group
from cohortspan.tables import Tables

# Widest gap a bar shows, and the limits between the gap classes, in years.
WIDEST_GAP = 15
CLEAR_GAP = 0.5
SMALLEST_GAP = 0.05


def trend_series(points: DataFrame) -> DataFrame:
    """Points that can be drawn: text columns DateText and ValueText parsed, the rest dropped."""
    value = F.col("ValueText").try_cast("double")
    return (
        points.withColumn("Date", iso_date(F.col("DateText")))
        .withColumn("Value", value)
        .where(F.col("Date").isNotNull() & F.col("Value").isNotNull() & ~F.isnan("Value"))
        .drop("DateText", "ValueText")
    )


def _padded(low: Column, high: Column) -> tuple[Column, Column]:
    padding = axis_padding(low, high)
    return low - padding, high + padding


def trend_axis_domain(series: DataFrame) -> DataFrame:
    """Extent of each user's chart of one biomarker."""
    spans = series.groupBy("UserID", "BiomarkerID").agg(
        F.min("Date").alias("MinDate"), F.max("Date").alias("MaxDate"), F.min("Value").alias("lo"), F.max("Value").alias("hi")
    )
    low, high = _padded(F.col("lo"), F.col("hi"))
    return spans.select("UserID", "BiomarkerID", "MinDate", "MaxDate", low.alias("MinValue"), high.alias("MaxValue"))


def history_series(t: Tables, as_of: dt.date | str, measure: str = "bioAgeYears") -> DataFrame:
    """One series per user and model of ``bioAgeYears`` or ``ageGap``."""
    value = F.col(measure).cast("double")
    return bio_age_history(t, as_of).select("userId", "modelName", "computedAt", value.alias("value")).where(
        "value IS NOT NULL"
    )


def actual_age_series(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Actual age beside the results, one point per user and time, from the lowest model."""
    actual = F.col("bioAgeYears").cast("double") - F.col("ageGap").cast("double")
    history = bio_age_history(t, as_of).withColumn("value", actual).where("value IS NOT NULL")
    return first_per_group(history, ["userId", "computedAt"], [F.col("modelId"), F.col("value")]).select(
        "userId", "computedAt", "value"
    )


def history_axis_domain(t: Tables, as_of: dt.date | str, measure: str = "bioAgeYears") -> DataFrame:
    """Extent of each user's history chart, over both models.

    Gaps always show zero and half a year around it; ages are drawn with the actual age and from zero.
    """
    value = F.col(measure).cast("double")
    actual = F.col("bioAgeYears").cast("double") - F.col("ageGap").cast("double")
    drawn = [value, actual] if measure == "bioAgeYears" else [value]
    # Rows without a value of either line do not reach the chart.
    points = bio_age_history(t, as_of).select("userId", "computedAt", F.array(*drawn).alias("drawn"))
    points = points.where(F.exists("drawn", lambda v: v.isNotNull()))
    spans = points.groupBy("userId").agg(
        F.min("computedAt").alias("minDate"),
        F.max("computedAt").alias("maxDate"),
        F.min(F.array_min("drawn")).alias("lo"),
        F.max(F.array_max("drawn")).alias("hi"),
    )
    spans = spans.withColumn("padding", axis_padding(F.col("lo"), F.col("hi")))
    low, high, padding = F.col("lo") - F.col("padding"), F.col("hi") + F.col("padding"), F.col("padding")
    zero = F.lit(0.0)
    if measure == "ageGap":
        least = F.when(low > 0, F.least(zero, low - padding)).otherwise(F.least(low, F.lit(-CLEAR_GAP)))
        most = F.when(high < 0, F.greatest(zero, high + padding)).otherwise(F.greatest(high, F.lit(CLEAR_GAP)))
    else:
        least, most = F.least(low, zero), high
    return spans.select("userId", "minDate", "maxDate", least.alias("minValue"), most.alias("maxValue"))


def gap_class(results: DataFrame) -> DataFrame:
    """Class of an age gap, and left edge and width of its bar in percent of a track centred on zero.

    Without a gap there is neither class nor bar.
    """
    gap = F.col("ageGap").cast("double")
    size = F.abs(gap)
    label = (
        F.when(size < SMALLEST_GAP, "neutral")
        .when(gap < -CLEAR_GAP, "younger")
        .when(gap < 0, "slightly_younger")
        .when(gap > CLEAR_GAP, "older")
        .otherwise("slightly_older")
    )
    width = F.when(size < SMALLEST_GAP, F.lit(1.5)).otherwise(
        F.greatest(F.least(size / F.lit(WIDEST_GAP) * 50, F.lit(50.0)), F.lit(0.5))
    )
    left = (
        F.when(size < SMALLEST_GAP, F.lit(50.0) - width / 2).when(gap < 0, F.lit(50.0) - width).otherwise(F.lit(50.0))
    )
    known = {"gapClass": label, "barWidth": width, "barLeft": left}
    return results.withColumns({name: F.when(gap.isNotNull(), column) for name, column in known.items()})


def with_display_domain(compared: DataFrame, mode: str = "both") -> DataFrame:
    """Axis of a range bar: the value and the bounds in play, padded. Rows without the ranges go.

    ``mode`` is ``clinical``, ``longevity`` or ``both``.
    """
    kinds = ("clinical", "longevity") if mode == "both" else (mode,)
    bounds = [f"{kind}{side}" for kind in kinds for side in ("Min", "Max")]
    ready = compared.dropna(subset=bounds)
    numbers = [F.col(name).cast("double") for name in ("value", *bounds)]
    low, high = F.least(*numbers), F.greatest(*numbers)
    level = F.when(low == 0, 1.0).otherwise(F.abs(low))
    flat = low == high
    low, high = F.when(flat, low - 0.5 * level).otherwise(low), F.when(flat, high + 0.5 * level).otherwise(high)
    ready = ready.withColumns({"__low": low, "__high": high})
    padding = (F.col("__high") - F.col("__low")) * 0.1
    return ready.withColumns(
        {"displayMin": F.col("__low") - padding, "displayMax": F.col("__high") + padding}
    ).drop("__low", "__high")


def range_bands(compared: DataFrame, mode: str = "both") -> DataFrame:
    """Coloured segments of each range bar, labelled by the ranges their middle lies in."""
    ready = with_display_domain(compared, mode)

    def bound(name: str) -> Column:
        return F.col(name).cast("double")

    kinds = ("clinical", "longevity") if mode == "both" else (mode,)
    bounds = [f"{kind}{side}" for kind in kinds for side in ("Min", "Max")]
    edges = F.array_sort(
        F.array_distinct(
            F.array(F.col("displayMin"), F.col("displayMax"), *[bound(name) for name in bounds])
        )
    )
    pairs = F.arrays_zip(
        F.slice("__edges", 1, F.size("__edges") - 1).alias("bandStart"),
        F.slice("__edges", 2, F.size("__edges") - 1).alias("bandEnd"),
    )
    cut = ready.withColumn("__edges", edges).select(
        "userId", "biomarkerId", "value", *bounds, "displayMin", "displayMax", F.posexplode(pairs).alias("band", "__pair")
    )
    start, end = F.col("__pair.bandStart"), F.col("__pair.bandEnd")
    middle = (start + end) / 2

    def within(kind: str) -> Column:
        return (bound(f"{kind}Min") <= middle) & (middle < bound(f"{kind}Max"))

    if mode == "clinical":
        label = F.when(within("clinical"), "Normal").otherwise("OutOfRange")
    elif mode == "longevity":
        label = F.when(within("longevity"), "Optimal").otherwise("Normal")
    else:
        label = (
            F.when(within("longevity"), "Optimal").when(within("clinical"), "Normal").otherwise("OutOfRange")
        )
    width = (end - start) / (F.col("displayMax") - F.col("displayMin")) * 100
    return cut.select(
        "userId",
        "biomarkerId",
        "value",
        (F.col("band") + 1).alias("band"),
        start.alias("bandStart"),
        end.alias("bandEnd"),
        label.alias("label"),
        width.alias("widthPercent"),
    )


def range_marker(compared: DataFrame, mode: str = "both") -> DataFrame:
    """Position of the value on its range bar in percent."""
    place = (F.col("value").cast("double") - F.col("displayMin")) / (F.col("displayMax") - F.col("displayMin")) * 100
    clamped = F.least(F.greatest(place, F.lit(0.0)), F.lit(100.0))
    return with_display_domain(compared, mode).select(
        "userId", "biomarkerId", "value", "displayMin", "displayMax", clamped.alias("markerPercent")
    )


def range_axis_domain(ranges: DataFrame) -> DataFrame:
    """Common axis of a biomarker's ranges, and offset and width of each range's bar on it."""
    low, high = F.col("MinVal").cast("double"), F.col("MaxVal").cast("double")
    valid = ranges.where(low <= high)
    spans = valid.groupBy("BiomarkerID").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    least, most = _padded(F.col("lo"), F.col("hi"))
    axes = spans.select("BiomarkerID", least.alias("axisMin"), most.alias("axisMax"))
    span = F.col("axisMax") - F.col("axisMin")
    offset = F.greatest((low - F.col("axisMin")) / span * 100, F.lit(0.0))
    width = F.greatest(
        F.least(F.greatest((high - low) / span * 100, F.lit(0.5)), F.lit(100.0) - offset), F.lit(0.0)
    )
    return valid.join(axes, "BiomarkerID").select(
        "BiomarkerID",
        "RangeType",
        "Sex",
        "AgeMin",
        "AgeMax",
        "MinVal",
        "MaxVal",
        "axisMin",
        "axisMax",
        offset.alias("barOffset"),
        width.alias("barWidth"),
    )


def session_ordinal(t: Tables) -> DataFrame:
    """Number of a visit in its user's order of dates, counted over years so no user is one task."""
    numbered = dense_ordinal(
        t.sessions,
        "Ordinal",
        ["UserID"],
        [F.year("SessionDate")],
        [F.col("SessionDate"), F.col("SessionID")],
    )
    return numbered.select("UserID", "SessionID", "SessionDate", F.col("Ordinal").cast("int").alias("Ordinal"))
