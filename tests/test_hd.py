import numpy as np
import pandas as pd
import pytest
from conftest import day, make_tables, moment, nine_values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspan.operators import hd, scores


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.RandomState(42)
    data = pd.DataFrame(
        {
            "A": rng.normal(100, 15, 30),
            "B": rng.normal(50, 10, 30),
            "C": rng.normal(200, 30, 30),
            "Age": rng.uniform(20, 30, 30),
        }
    )
    return data, spark.createDataFrame(data)


def by_numpy(data: pd.DataFrame, columns: list[str], points: pd.DataFrame) -> np.ndarray:
    z = (data[columns] - data[columns].mean()) / data[columns].std()
    inverse = np.linalg.inv(np.cov(z.T.values))
    p = ((points[columns] - data[columns].mean()) / data[columns].std()).values
    return np.sqrt(np.einsum("ij,jk,ik->i", p, inverse, p))


def test_distance_equals_numpy(spark, small):
    data, df = small
    model = hd.fit(df, ["A", "B", "C"])
    probe = pd.DataFrame({"A": [110.0], "B": [45.0], "C": [220.0]})
    found = hd.batch(spark.createDataFrame(probe), model).first()
    assert found["HD_score"] == pytest.approx(by_numpy(data, ["A", "B", "C"], probe)[0], abs=1e-9)
    line = np.polyfit(data["Age"], by_numpy(data, ["A", "B", "C"], data), 1)
    assert (model.slope, model.intercept) == pytest.approx(tuple(line), abs=1e-9)
    assert found["HD_years"] == pytest.approx(line[0] * found["HD_score"] + line[1])


def test_mean_has_distance_zero_and_squares_add_up(spark, small):
    data, df = small
    model = hd.fit(df, ["A", "B", "C"], age_column=None)
    means = spark.createDataFrame(data[["A", "B", "C"]].mean().to_frame().T)
    assert hd.batch(means, model, convert_to_years=False).first()["HD_score"] == pytest.approx(0, abs=1e-7)
    squares = hd.batch(df, model, convert_to_years=False).agg(F.sum(F.col("HD_score") ** 2)).first()[0]
    assert squares == pytest.approx(29 * 3)


def test_missing_value_and_missing_column(spark, small):
    _, df = small
    model = hd.fit(df, ["A", "B", "C"])
    row = hd.batch(spark.createDataFrame([(None, 1.0, 2.0)], "A DOUBLE, B DOUBLE, C DOUBLE"), model).first()
    assert row["HD_score"] is None and row["HD_years"] is None
    with pytest.raises(ValueError, match="missing biomarker columns"):
        hd.batch(df.drop("C"), model)


def test_reference_must_be_large_and_regular(spark, small):
    _, df = small
    with pytest.raises(hd.HDUnavailable, match="too small"):
        hd.fit(df.limit(19), ["A", "B", "C"])
    assert hd.fit(df.limit(20), ["A", "B", "C"]).rows == 20
    with pytest.raises(hd.HDUnavailable, match="singular"):
        hd.fit(df.withColumn("C", 2 * F.col("A") + 1), ["A", "B", "C"])
    with pytest.raises(hd.HDUnavailable, match="vary"):
        hd.fit(df.withColumn("C", F.lit(1.0)), ["A", "B", "C"])


def test_large_offsets_do_not_cancel(spark, small):
    data, _ = small
    moved = data.assign(A=data["A"] + 1e9)
    model = hd.fit(spark.createDataFrame(moved), ["A", "B", "C"], age_column=None)
    found = [r["HD_score"] for r in hd.batch(spark.createDataFrame(moved), model, False).collect()]
    assert found == pytest.approx(list(by_numpy(moved, ["A", "B", "C"], moved)), rel=1e-5)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(2, 5))
def test_any_number_of_biomarkers(spark, seed, width):
    rng = np.random.RandomState(seed)
    names = [f"n{i}" for i in range(width)]
    data = pd.DataFrame(rng.normal(size=(40, width)) @ rng.normal(size=(width, width)) + 5, columns=names)
    model = hd.fit(spark.createDataFrame(data), names, age_column=None)
    found = [r["HD_score"] for r in hd.batch(spark.createDataFrame(data), model, False).collect()]
    assert found == pytest.approx(list(by_numpy(data, names, data)), rel=1e-6, abs=1e-9)


@pytest.fixture(scope="module")
def population(spark):
    """30 young persons with all biomarkers, one of them twice measured, one with few values."""
    rng = np.random.RandomState(7)
    users, sessions, values, bodies = [], [], [], []
    for u in range(1, 31):
        users.append((u, u, day("2000-02-01"), "M" if u % 2 else "F", "g"))
        sessions.append((u, u, day("2024-01-01"), True))
        numbers = rng.normal([4.5, 70, 0.9, 88, 1.5, 6, 30, 90, 13], [0.3, 12, 0.1, 8, 0.4, 1, 4, 4, 0.6])
        changed = {f"b{i}": f"{abs(v):.3f}" for i, v in enumerate(numbers, start=1)}
        if u == 30:
            changed["b9"] = None
        values += nine_values(u, "2024-01-01 08:00:00", **changed)
        bodies.append((u, day("2024-01-01"), "170", "65", "22.5"))
    bodies += [(1, day("2024-02-01"), "170", "66", "22.8"), (2, day("2024-02-01"), "170", "66", "22.5")]
    return make_tables(spark, users, sessions, values, bodies)


def test_reference_counts_distinct_body_indices(population):
    rows = hd.reference_wide(population, "2024-06-01").collect()
    assert len(rows) == 30  # 29 complete persons, the first with two indices, the second twice the same
    assert sorted(r["BMI"] for r in rows if r["UserID"] == 1) == [22.5, 22.8]
    assert rows[0]["Fasting Glucose"] < 10  # in mmol/L


def test_calculate_scores_both_models(population):
    rows = scores.calculate(population, "2024-06-01").collect()
    assert len(rows) == 60
    assert {r["Status"] for r in rows if r["UserID"] == 30} == {"insufficient_biomarkers"}
    assert all(r["BioAgeYears"] is not None for r in rows if r["UserID"] != 30)


def test_calculate_without_reference_population(population):
    rows = scores.calculate(population, "2024-06-01", min_rows=500)
    by_model = {r["ModelID"]: r for r in rows.where("UserID = 1").collect()}
    assert by_model[1]["Status"] == "ok"
    assert by_model[2]["Status"] == "hd_unavailable" and by_model[2]["BioAgeYears"] is None
    strict = scores.calculate(population, "2024-06-01", strict=True, min_rows=500)
    assert strict.where("BioAgeYears IS NOT NULL").count() == 0


def test_calculate_by_name(population):
    rows = scores.calculate(population, "2024-06-01", "Phenotypic Age").select("ModelID").distinct().collect()
    assert [r["ModelID"] for r in rows] == [1]
    with pytest.raises(ValueError, match="invalid model"):
        scores.calculate(population, "2024-06-01", "Horoscope")


def test_results_are_appended_once(spark, population, tmp_path):
    folder = str(tmp_path / "results")
    population.results.write.parquet(folder)
    scored = scores.calculate(population, "2024-06-01", "Phenotypic Age")
    for _ in range(2):
        scores.append_results(scored, "2024-06-01 12:00:00", folder)
    assert spark.read.parquet(folder).count() == 29
    scores.append_results(scored, "2024-06-02 12:00:00", folder)
    assert spark.read.parquet(folder).count() == 58
    assert moment("2024-06-01 12:00:00") in {r[0] for r in spark.read.parquet(folder).select("ComputedAt").collect()}


def test_scores_with_one_key_are_appended_once(spark, tmp_path):
    from cohortspan.operators import scores

    rows = spark.createDataFrame([(1, 1, 40.0), (1, 1, 41.0), (1, 2, 39.0), (2, 1, None)], "UserID INT, ModelID INT, BioAgeYears DOUBLE")
    folder = str(tmp_path / "results")
    spark.createDataFrame([], "UserID INT, ModelID INT, BioAgeYears DECIMAL(5,2), ComputedAt TIMESTAMP").write.parquet(folder)
    for _ in range(2):
        scores.append_results(rows, "2024-01-01 00:00:00", folder)
    found = spark.read.parquet(folder).collect()
    assert sorted((r["UserID"], r["ModelID"], float(r["BioAgeYears"])) for r in found) == [(1, 1, 41.0), (1, 2, 39.0)]
