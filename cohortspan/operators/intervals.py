"""Reference ranges as elementary intervals: sorted break points with the outcome between them.

Ranges that overlap in age and value are cut, per biomarker and sex, into bands of age in which the same ranges hold, and
per band into intervals of value in which the same number of ranges holds. A value is looked up by two joins on equal
columns and a binary search in each, whatever the number of ranges: no row is compared with every range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.schemas import DOMAINS
from cohortspan.session import cut_lineage

SEXES = DOMAINS[("users", "Sex")]
# Stands for users whose sex is not known: only ranges for all hold for them.
ANY_SEX = "*"
# From one value to the next that a column with four decimals can hold.
STEP = "0.0001"

KEY = ["BiomarkerID", "SexKey"]


def sex_key(sex: Column) -> Column:
    return F.when(sex.isin(SEXES), sex).otherwise(ANY_SEX)


def place(breaks: Column, value: Column) -> Column:
    """How many of the sorted ``breaks`` are not above ``value``, by bisection; 0 for a NULL."""
    span = F.struct(F.lit(0).alias("low"), F.size(breaks).alias("high"))
    middle = lambda s: F.shiftright(s["low"] + s["high"], 1)

    def halved(s: Column, _: Column) -> Column:
        up = F.coalesce(F.get(breaks, middle(s)) <= value, F.lit(False))
        open_ = s["low"] < s["high"]
        low = F.when(open_ & up, middle(s) + 1).otherwise(s["low"])
        high = F.when(open_ & ~up, middle(s)).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    # As many halvings as the number of breaks has binary digits.
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(breaks).cast("bigint"))))
    return F.aggregate(halvings, span, halved, lambda s: s["low"])


def index(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Age breaks per biomarker and sex, and what holds in every band of age: bounds per kind, value breaks, counts.

    Both are stored, so Spark knows how large they are before it plans the lookups.
    """
    sexes = F.when(F.col("Sex") == "All", F.array(*map(F.lit, [*SEXES, ANY_SEX]))).otherwise(F.array("Sex"))
    cut = ranges.where("AgeMin <= AgeMax").withColumn("SexKey", F.explode(sexes)).withColumn("AgeEnd", F.col("AgeMax") + 1)
    points = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("AgeMin", "AgeEnd")))))
    ages = cut_lineage(cut.groupBy(*KEY).agg(points.alias("Ages")), "age-breaks")
    bands = F.sequence(F.array_position("Ages", F.col("AgeMin")), F.array_position("Ages", F.col("AgeEnd")) - 1)
    held = cut.join(ages, KEY).withColumn("Band", F.explode(bands)).withColumn("Band", F.col("Band").cast("int"))
    band = [*KEY, "Band"]
    bounds = held.groupBy(*band).agg(
        *[
            F.max(F.when(F.col("RangeType") == kind, F.struct("MinVal", "MaxVal"))).alias(kind)
            for kind in ("clinical", "longevity")
        ]
    )
    ends = F.array(
        F.struct(F.col("MinVal").cast("decimal(13,4)").alias("At"), F.lit(1).alias("Change")),
        F.struct((F.col("MaxVal") + F.lit(STEP).cast("decimal(5,4)")).cast("decimal(13,4)").alias("At"), F.lit(-1).alias("Change")),
    )
    changes = held.where("MinVal <= MaxVal").select(*band, F.explode(ends).alias("e")).groupBy(*band, "e.At").agg(F.sum("e.Change").alias("Change"))
    running = F.sum("Change").over(Window.partitionBy(*band).orderBy("At"))
    steps = F.array_sort(F.collect_list(F.struct("At", "Hits")))
    values = changes.select(*band, "At", running.alias("Hits")).groupBy(*band).agg(steps.alias("Steps"))
    outcome = bounds.join(values, band, "left").select(
        *band, "clinical", "longevity", F.col("Steps.At").alias("Breaks"), F.col("Steps.Hits").alias("Counts")
    )
    return ages, cut_lineage(outcome, "range-bands")


def looked_up(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``values`` (BiomarkerID, UserSex, Age, Value and others) with ``hits`` and the bounds of each kind of range.

    Rows without any range for their biomarker, sex and age go.
    """
    ages, outcome = index(ranges)
    found = values.withColumn("SexKey", sex_key(F.col("UserSex"))).join(ages, KEY)
    found = found.withColumn("Band", place(F.col("Ages"), F.col("Age"))).drop("Ages").join(outcome, [*KEY, "Band"])
    hits = F.get("Counts", place(F.col("Breaks"), F.col("Value")) - 1)
    return found.withColumn("hits", F.coalesce(hits, F.lit(0))).drop("Breaks", "Counts", "Band", "SexKey")
