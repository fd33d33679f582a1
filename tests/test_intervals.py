"""Elementary intervals against a comparison of every value with every range."""

import random
from decimal import Decimal


from pyspark.sql import functions as F

from cohortspan.operators import intervals, queries

RANGES = "BiomarkerID INT, RangeType STRING, Sex STRING, AgeMin INT, AgeMax INT, MinVal DECIMAL(12,4), MaxVal DECIMAL(12,4)"
VALUES = "Row INT, BiomarkerID INT, UserSex STRING, Age INT, Value DECIMAL(12,4)"


def fits(value, r):
    _, b, sex, age, _ = value
    return b == r[0] and (r[2] == "All" or r[2] == sex) and None not in (age, r[3], r[4]) and r[3] <= age <= r[4]


def expected(values, ranges):
    out = {}
    for v in values:
        held = [r for r in ranges if fits(v, r)]
        if held:
            hits = sum(None not in (r[5], r[6]) and r[5] <= v[4] <= r[6] for r in held)
            out[v[0]] = (hits, *[max(((r[5], r[6]) for r in held if r[1] == kind), key=str, default=None) for kind in ("clinical", "longevity")])
    return out


def test_any_ranges(spark):
    rng = random.Random(5)
    number = lambda: Decimal(rng.randint(0, 60)) / Decimal(4)
    ranges = []
    for _ in range(120):
        low, age = number(), rng.choice([None, rng.randint(0, 90)])
        ranges.append((
            rng.randint(1, 4), rng.choice(["clinical", "longevity", "other"]), rng.choice(["M", "F", "All"]), age,
            rng.choice([None, (age or 0) + rng.randint(-3, 40)]), low, rng.choice([low, low + number(), low - 1]),
        ))
    values = [(k, rng.randint(1, 5), rng.choice(["M", "F", None]), rng.choice([None, rng.randint(-5, 140)]), number()) for k in range(600)]
    df = intervals.looked_up(spark.createDataFrame(values, VALUES), spark.createDataFrame(ranges, RANGES))
    found = {r["Row"]: r for r in df.collect()}
    wanted = expected(values, ranges)
    assert (found.keys() - wanted.keys(), wanted.keys() - found.keys()) == (set(), set())
    assert len(wanted) > 50
    for k, (hits, clinical, longevity) in wanted.items():
        assert found[k]["hits"] == hits
        assert (found[k]["clinical"] is None) == (clinical is None) and (found[k]["longevity"] is None) == (longevity is None)


def test_ends_belong_to_a_range(spark):
    ranges = spark.createDataFrame([(1, "clinical", "All", 20, 30, Decimal("4.0000"), Decimal("5.0000"))], RANGES)
    values = [(k, 1, "M", age, Decimal(v)) for k, (age, v) in enumerate([(20, "4"), (30, "5"), (25, "5.0001"), (25, "3.9999"), (19, "4.5"), (31, "4.5")])]
    found = {r["Row"]: r["hits"] for r in intervals.looked_up(spark.createDataFrame(values, VALUES), ranges).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0}


def test_bisection(spark):
    breaks = [1, 3, 3, 7, 20]
    rows = [(sorted(set(breaks[:n])), x) for n in range(6) for x in (None, 0, 1, 2, 3, 7, 19, 20, 21)]
    df = spark.createDataFrame(rows, "b ARRAY<INT>, x INT").select("b", "x", intervals.place(F.col("b"), F.col("x")).alias("p"))
    for r in df.collect():
        assert r["p"] == (0 if r["x"] is None else sum(v <= r["x"] for v in r["b"]))


def test_no_join_compares_ages_or_values(spark, personas):
    df = queries.range_comparison(personas, "2024-06-01", match_age=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("NestedLoop" in line or "Cartesian" in line or "AgeM" in line or "Val#" in line for line in joins)


def test_empty_ranges(spark):
    values = spark.createDataFrame([(1, 1, "M", 30, Decimal(4))], VALUES)
    assert intervals.looked_up(values, spark.createDataFrame([], RANGES)).collect() == []
