import pytest
from conftest import day, make_tables, moment
from pyspark.sql import functions as F

from cohortspan.functions.dates import calendar_years, duration_days, full_years
from cohortspan.operators import queries as q
from cohortspan.operators import views

AS_OF = "2024-05-01"


def test_full_and_calendar_years(spark):
    rows = spark.createDataFrame(
        [("2000-05-01",), ("2000-05-02",), ("2000-12-31",), ("2000-02-29",), (None,)], "b STRING"
    ).withColumn("b", F.col("b").cast("date"))
    found = rows.select(full_years(F.col("b"), AS_OF), calendar_years(F.col("b"), AS_OF)).collect()
    assert [tuple(r) for r in found] == [(24, 24), (23, 24), (23, 24), (24, 24), (None, None)]
    leap = rows.where("b = DATE '2000-02-29'").select(full_years(F.col("b"), "2001-02-28"))
    assert leap.first()[0] == 0


@pytest.mark.parametrize(
    "text, days",
    [
        ("6months", 186),
        ("6 months", 186),
        (" 6 MONTH ", 186),
        ("2 weeks", 14),
        ("1year", 365),
        ("0 days", 0),
        ("\t3 days\n", 3),
        ("3", None),
        ("days", None),
        ("-1 days", None),
        ("3 month s", None),
        ("3 fortnights", None),
        ("", None),
        (None, None),
        ("99999999999999999999 days", None),
    ],
)
def test_duration(spark, text, days):
    assert spark.range(1).select(duration_days(F.lit(text).cast("string"))).first()[0] == days


@pytest.fixture(scope="module")
def people(spark):
    """1 with two visits and a tie, 2 without sex and birth date, 3 without visits."""
    users = [
        (1, 11, day("1990-06-01"), "F", "g"),
        (2, 12, None, None, "g"),
        (3, 13, day("2010-01-01"), "M", "g"),
        (4, 14, day("1970-01-01"), "M", "g"),
    ]
    sessions = [
        (1, 1, day("2024-01-01"), True),
        (2, 1, day("2024-02-01"), None),
        (3, 2, day("2024-01-01"), False),
        (4, 4, day("2023-11-01"), False),
        (5, 4, day("2023-10-31"), False),
    ]
    noon = moment("2024-03-01 12:00:00")
    measurements = [
        (1, 1, "4.0", noon),
        (2, 1, "4.0", noon),  # same value at the same time as the row above
        (1, 3, "0.7", noon),
        (2, 4, "99", noon),
        (2, 5, "3.0001", noon),
        (3, 3, "0.9", noon),
        (4, 4, "85", moment("2023-11-01 08:00:00")),
        (5, 4, "200", moment("2023-10-31 08:00:00")),
    ]
    bodies = [
        (1, day("2024-01-01"), None, None, None),
        (3, day("2024-01-01"), "170", "53", "18.49"),
        (3, day("2024-02-01"), "170", "54", "18.50"),
        (4, day("2024-01-01"), "170", "80", "30.00"),
        (4, day("2024-02-01"), "170", "72", "25.00"),
    ]
    results = [
        (1, 1, "30.50", noon),
        (1, 1, "31.50", moment("2024-04-01 00:00:00")),
        (1, 2, "40.00", noon),
        (2, 1, "50.00", noon),
    ]
    return make_tables(spark, users, sessions, measurements, bodies, results)


def test_latest_keeps_ties(people):
    rows = views.latest_measurements(people).where("UserID = 1 AND BiomarkerID = 1").collect()
    assert len(rows) == 2
    newest = views.latest_measurements(people).where("UserID = 4").collect()
    assert [(r["BiomarkerID"], float(r["Value"])) for r in newest] == [(4, 85.0)]


def test_range_comparison(people):
    rows = {(r["userId"], r["biomarkerId"]): r for r in q.range_comparison(people).collect()}
    assert rows[(1, 3)]["status"] == "Optimal"  # on the lower longevity bound for women
    assert float(rows[(1, 3)]["clinicalMin"]) == 0.6
    assert rows[(1, 4)]["status"] == "Normal"  # on the upper clinical bound
    assert rows[(1, 5)]["status"] == "OutOfRange"  # just above it
    assert rows[(1, 1)]["status"] == "OutOfRange"  # tied values hit four times
    assert (2, 3) not in rows  # without a sex no range by sex applies
    assert rows[(4, 4)]["status"] == "Optimal"


def test_range_comparison_by_age_and_type(spark, people):
    from cohortspan import catalog

    etl = people.replace(ranges=catalog.ranges(spark, "etl"))
    by_age = {(r["userId"], r["biomarkerId"]): r for r in q.range_comparison(etl, AS_OF, match_age=True).collect()}
    assert by_age[(4, 4)]["longevityMin"] is None  # 54 is beyond the longevity ages
    assert by_age[(4, 4)]["status"] == "Normal"
    assert (2, 3) not in by_age
    only = q.range_comparison(etl, AS_OF, match_age=True, only="longevity")
    assert only.count() == 0
    text = q.ranges_as_json(q.range_comparison(people)).where("userId = 4").first()
    assert text["clinicalRange"] == '{"min":70.0000,"max":99.0000}'


def test_trend_period_and_limit(people):
    inside = q.trend(people, AS_OF, within="6 months").where("userId = 4")  # 186 days before is 2023-10-28
    assert inside.count() == 2
    # 182 days before is 2023-11-01, which does not belong to the period.
    assert q.trend(people, AS_OF, within="26 weeks").where("userId = 4").count() == 0
    assert q.trend(people, AS_OF, within="183 days").where("userId = 4").count() == 1
    newest = q.trend(people, AS_OF, limit=1, within="1 year").where("userId = 4").collect()
    assert [str(r["date"]) for r in newest] == ["2023-11-01"]
    with pytest.raises(ValueError):
        q.trend(people, AS_OF, within="soon")


def test_users_and_sessions(people):
    rows = {r["userId"]: r for r in q.list_users(people, AS_OF).collect()}
    assert [rows[u]["sessionCount"] for u in (1, 2, 3, 4)] == [2, 1, 0, 2]
    assert rows[2]["age"] is None
    assert q.user_profile(people, AS_OF).where("userId = 3").first()["biomarkerId"] is None
    nested = {r["UserID"]: r for r in q.user_profile_nested(people, AS_OF).collect()}
    assert [b["biomarkerId"] for b in nested[1]["biomarkers"]] == [1, 1, 3, 4, 5]
    assert nested[3]["biomarkers"] is None
    assert q.user_profile(people, AS_OF).where("userId = 99").count() == 0
    assert q.session_details(people).where("userId = 2 AND sessionId = 1").count() == 0
    assert len(q.session_details_nested(people).where("sessionId = 2").first()["measurements"]) == 3


def test_results(people):
    gaps = {(r["userId"], r["modelId"], float(r["bioAgeYears"])): r["ageGap"] for r in q.bio_age(people, AS_OF).collect()}
    assert float(gaps[(1, 1, 30.5)]) == -2.5 and gaps[(2, 1, 50.0)] is None
    assert q.bio_age_latest(people, AS_OF).where("userId = 1 AND modelId = 1").first()["bioAgeYears"] == 31.5
    assert q.bio_age_history(people, AS_OF, "Phenotypic Age").count() == 3
    assert q.bio_age_history(people, AS_OF, "no such model").count() == 4
    stamp = people.results.where("BioAgeYears = 31.5").select(q.iso_timestamp(F.col("ComputedAt"))).first()[0]
    assert stamp == "2024-04-01T00:00:00Z"


def test_age_groups(people):
    rows = {(r["AgeGroup"], r["Sex"]): r["UserCount"] for r in q.age_distribution(people, AS_OF).collect()}
    assert rows == {("30-39", "F"): 1, ("60+", None): 1, ("20-29", "M"): 1, ("60+", "M"): 1}
    full = {(r["AgeGroup"], r["Sex"], r["Level"]): r["UserCount"] for r in q.age_distribution_rollup(people, AS_OF).collect()}
    assert full[(None, None, 3)] == 4 and full[("0-19", "M", 0)] == 1 and full[("unknown", None, 0)] == 1
    assert full[("50-59", None, 1)] == 1
    ordered = q.age_distribution(people, AS_OF).orderBy("AgeGroup", q.sex_order(F.col("Sex"))).collect()
    assert [r["Sex"] for r in ordered if r["AgeGroup"] == "60+"] == [None, "M"]


def test_body_mass_classes(people):
    rows = [(r["UserID"], r["BMI_Category"]) for r in views.anthropometry_history(people).orderBy("UserID", "ExamDate").collect()]
    assert rows == [(1, "Obese"), (3, "Underweight"), (3, "Normal"), (4, "Obese"), (4, "Overweight")]


def test_reference_candidates_by_calendar_year(spark):
    t = make_tables(
        spark,
        [(1, 1, day("2004-12-31"), "M", "g"), (2, 2, day("1993-12-31"), "M", "g"), (3, 3, day("1994-01-01"), "M", "g")],
        anthropometry=[(u, day("2024-01-01"), "170", "60", "18.50") for u in (1, 2, 3)],
    )
    found = {r["UserID"]: r["Age"] for r in views.hd_reference_candidates(t, AS_OF).collect()}
    assert found == {1: 20, 3: 30}


def test_summary_counts_unmeasured_biomarkers(people):
    rows = {r["Name"]: r["MeasurementCount"] for r in q.measurement_summary(people).collect()}
    assert rows["Albumin"] == 2 and rows["Mean Corpuscular Volume"] == 0 and len(rows) == 9
    counts = {r["UserID"]: (r["Sessions"], r["Biomarkers"]) for r in q.demo_user_counts(people).collect()}
    assert counts == {1: (2, 4), 2: (1, 1), 3: (0, 0), 4: (2, 1)}
    assert q.demo_user_counts(people, 12, 13).count() == 2


def test_catalogs(spark):
    from cohortspan import catalog

    for name in ("seed", "etl"):
        kinds = catalog.ranges(spark, name).groupBy("RangeType").count().collect()
        assert {r["RangeType"]: r["count"] for r in kinds} == {"clinical": 10, "longevity": 10}
    assert catalog.ranges(spark).where("BiomarkerID = 3").select("Sex").distinct().count() == 2
    codes = [r[0] for r in catalog.biomarkers(spark).orderBy("BiomarkerID").select("NHANESVarCode").collect()]
    assert codes == "LBXSAL LBXSAPSI LBXSCR LBXGLU LBXHSCRP LBXWBCSI LBXLYPCT LBXMCVSI LBXRDW".split()
    with pytest.raises(ValueError):
        catalog.ranges(spark, "other")
