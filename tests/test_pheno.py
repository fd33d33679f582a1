import math

import pytest
from conftest import day, make_tables, moment, nine_values, persona_rows
from pyspark.sql import functions as F

from cohortspan.catalog import COEFFICIENTS
from cohortspan.operators import pheno
from cohortspan.operators.views import latest_measurements


def scores(t, as_of):
    return {r["UserID"]: r for r in pheno.phenotypic_age(t, as_of).collect()}


def test_known_persons(personas):
    found = scores(personas, "2024-05-01")
    assert {u: (r["Age"], r["BioAgeYears"]) for u, r in found.items()} == {
        1: (29, 26.60),
        2: (45, 53.42),
        3: (38, 37.13),
        4: (25, 35.41),
        5: (72, 69.03),
        6: (59, 79.69),
    }
    assert found[1]["AgeGap"] == -2.40
    assert all(r["Status"] == "ok" for r in found.values())


def test_known_person_at_an_earlier_visit(spark):
    t = make_tables(spark, *persona_rows(until="2023-06-01"))
    assert scores(t, "2023-05-01")[3]["BioAgeYears"] == 44.10


def test_plain_python_agrees(personas):
    row = next(r for r in pheno.phenotypic_age(personas, "2024-05-01").collect() if r["UserID"] == 2)
    values = dict(enumerate((3.8, 105, 1.10, 98, 3.2, 7.8, 25, 94, 14.0), start=1))
    total = 0.0
    for _, biomarker, coefficient, transform in COEFFICIENTS:
        x = values[biomarker] / 18.0 if biomarker == 4 else values[biomarker]
        total += float(coefficient) * (math.log(x) if transform == "log" else x)
    score = total + 45 * 0.0804 - 19.9067
    risk = min(0.999999, 1 - math.exp(-math.exp(score)))
    assert row["BioAgeYears"] == pytest.approx(141.5 + math.log(-math.log(1 - risk)) / 0.09165, abs=0.0051)


def test_glucose_contribution(spark):
    t = make_tables(
        spark, [(1, 1, day("1980-01-01"), "M", "g")], [(1, 1, day("2024-01-01"), True)], [(1, 4, "90", moment("2024-01-01"))]
    )
    assert pheno.terms(latest_measurements(t), t.coefficients).first()["Term"] == pytest.approx(0.9765)


@pytest.fixture(scope="module")
def odd_users(spark):
    """1 complete, 2 five biomarkers, 3 ten rows by a tie, 4 CRP of zero, 5 no birth date, 6 nothing,
    7 nine rows but eight biomarkers, 8 beyond the cap."""
    users = [(u, u, None if u == 5 else day("1980-01-01"), "M", "g") for u in range(1, 9)]
    sessions = [(u, u, day("2024-01-01"), True) for u in range(1, 9) if u != 6]
    sessions += [(31, 3, day("2024-01-02"), True), (71, 7, day("2024-01-02"), True)]
    when = "2024-01-01 10:00:00"
    rows = nine_values(1, when)
    rows += nine_values(2, when, b6=None, b7=None, b8=None, b9=None)
    rows += nine_values(3, when) + [(31, 1, "4.0", moment(when))]
    rows += nine_values(4, when, b5="0")
    rows += nine_values(5, when)
    rows += nine_values(7, when, b9=None) + [(71, 1, "4.0", moment(when))]
    rows += nine_values(8, when, b4="9000")
    return make_tables(spark, users, sessions, rows)


def test_status_of_odd_users(odd_users):
    found = scores(odd_users, "2024-05-01")
    assert {u: r["Status"] for u, r in found.items()} == {
        1: "ok",
        2: "insufficient_biomarkers",
        3: "insufficient_biomarkers",
        4: "invalid_value",
        5: "invalid_value",
        6: "insufficient_biomarkers",
        7: "invalid_value",
        8: "ok",
    }
    assert {u for u, r in found.items() if r["BioAgeYears"] is None} == {2, 3, 4, 5, 6, 7}


def test_cap(odd_users):
    assert scores(odd_users, "2024-05-01")[8]["BioAgeYears"] == 170.15


def test_underflow_is_invalid(spark):
    score = spark.range(1).select(pheno.age_from_mortality(F.lit(-40.0)).alias("a")).first()["a"]
    assert score is None


def test_slope_per_year_below_the_cap(spark):
    rows = spark.range(20, 90).select(
        pheno.age_from_mortality(pheno.mortality_score(F.lit(9.0), F.col("id"))).alias("a")
    )
    ages = [r["a"] for r in rows.collect()]
    steps = [b - a for a, b in zip(ages, ages[1:])]
    assert all(s == pytest.approx(0.0804 / 0.09165, abs=0.011) for s in steps)
