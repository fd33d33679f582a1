"""What is merged per load equals what is computed from everything."""

import random
from pathlib import Path

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from cohortspan.operators import comoments, hd, latest
from cohortspan.sources.star import survey_tables


def values(spark, rows):
    made = [(u, s, b, str(v), f"2024-01-{d:02d} 09:00:00") for u, s, b, v, d in rows]
    df = spark.createDataFrame(made, "UserID INT, SessionID INT, BiomarkerID INT, Value STRING, TakenAt STRING")
    return df.select("UserID", "SessionID", "BiomarkerID", F.col("Value").cast("decimal(12,4)").alias("Value"), F.col("TakenAt").cast("timestamp").alias("TakenAt"))


def newest(rows):
    best = {}
    for u, s, b, v, d in rows:
        best[u, b] = max(best.get((u, b), 0), d)
    return sorted((u, s, b, float(v)) for u, s, b, v, d in rows if best[u, b] == d)


def held(table):
    return sorted((r["UserID"], r["SessionID"], r["BiomarkerID"], float(r["Value"])) for r in table.read().collect())


def random_rows(seed, count, first_session=0):
    rng = random.Random(seed)
    return [(rng.randint(1, 40), first_session + k, rng.randint(1, 3), rng.randint(1, 99), rng.randint(1, 9)) for k in range(count)]


def files(table):
    return {str(p): p.stat().st_mtime_ns for p in Path(table.folder, "rows").rglob("part-*")}


def test_loads_merge_into_the_full_view(spark, tmp_path):
    rows = random_rows(1, 300)
    table = latest.create(spark, str(tmp_path / "t"), values(spark, rows), 8)
    assert held(table) == newest(rows)
    for k in range(2):
        load = random_rows(10 + k, 60, 1000 * (k + 1))
        rows += load
        table = latest.merge(latest.open_table(spark, table.folder), values(spark, load))
        assert held(table) == newest(rows)


def test_a_load_touches_the_buckets_of_its_users_only(spark, tmp_path):
    rows = random_rows(2, 300)
    table = latest.create(spark, str(tmp_path / "t"), values(spark, rows), 8)
    before = files(table)
    load = [(7, 900, 1, 5, 9), (7, 901, 2, 6, 1)]
    table = latest.merge(table, values(spark, load))
    after = files(table)
    bucket = values(spark, load).select(table.bucket()).first()[0]
    assert {p for p in before if f"bucket={bucket}/" not in p} == {p for p in after if f"bucket={bucket}/" not in p}
    assert all(after[p] == before[p] for p in before if f"bucket={bucket}/" not in p) and set(before) != set(after)
    assert held(table) == newest(rows + load)


def test_a_value_that_comes_again_replaces_the_stored_one(spark, tmp_path):
    table = latest.create(spark, str(tmp_path / "t"), values(spark, [(1, 5, 1, 4, 3), (1, 6, 1, 5, 3)]), 4)
    assert held(latest.merge(table, values(spark, [(1, 5, 1, 9, 3)]))) == [(1, 5, 1, 9.0), (1, 6, 1, 5.0)]


def test_users_whose_rows_disappear_are_computed_anew(spark, tmp_path):
    rows = random_rows(3, 200)
    table = latest.create(spark, str(tmp_path / "t"), values(spark, rows), 8)
    left = [r for r in rows if not (r[0] == 5 and r[4] > 3) and r[0] != 9]
    users = spark.createDataFrame([(5,), (9,), (5,)], "UserID INT")
    assert held(latest.recompute(table, values(spark, left), users)) == newest(left)
    only = latest.create(spark, str(tmp_path / "one"), values(spark, [(1, 5, 1, 4, 3)]), 4)
    assert held(latest.recompute(only, values(spark, []), spark.createDataFrame([(1,)], "UserID INT"))) == []


@pytest.fixture(scope="module")
def reference(spark):
    t = survey_tables(spark, SMALL)
    return hd.reference_wide(t, "2001-12-31").cache()


def same(a: hd.HDModel, b: hd.HDModel):
    assert a.rows == b.rows
    assert np.allclose(a.means, b.means, rtol=1e-9, atol=0) and np.allclose(a.stds, b.stds, rtol=1e-9, atol=0)
    assert np.allclose(a.precision, b.precision, rtol=1e-7, atol=1e-9)


def test_merged_parts_fit_like_all_rows(spark, reference):
    parts = comoments.summed(reference, by=[F.col("UserID") % 5])
    assert parts.count() == 5
    same(comoments.fit(parts), hd.fit(reference, age_column=None))
    found = {r["Biomarker"]: r for r in comoments.deviations(comoments.merged(parts)).collect()}
    for r in hd.moments(reference).collect():
        assert found[r["Biomarker"]]["Mean"] == pytest.approx(r["Mean"], rel=1e-9)
        assert found[r["Biomarker"]]["Std"] == pytest.approx(r["Std"], rel=1e-9)
        assert found[r["Biomarker"]]["ReferenceRows"] == r["ReferenceRows"]


def test_a_load_is_taken_in_without_the_other_rows(spark, reference):
    parts = comoments.summed(reference, by=[F.col("UserID") % 3])
    touched = F.col("UserID") % 7 == 0
    changed = reference.where(touched).withColumn("Albumin", F.col("Albumin") * 1.1).where("UserID % 14 = 0")
    now = reference.where(~touched).unionByName(changed)
    after = comoments.after_load(parts, reference.where(touched), changed)
    same(comoments.fit(after), hd.fit(now, age_column=None))


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), *(1e9 + rng.normal(size=3)).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "k INT, a DOUBLE, b DOUBLE, c DOUBLE")
    names = ("a", "b", "c")
    row = comoments.merged(comoments.summed(df, names, by=[F.col("k") % 4]), names)
    found = [r["Std"] for r in comoments.deviations(row, names).collect()]
    exact = np.array([r[1:] for r in rows]).std(axis=0, ddof=1)
    assert np.allclose(found, exact, rtol=1e-6)


def test_parts_without_rows(spark, reference):
    nobody = reference.limit(0)
    assert comoments.summed(nobody).count() == 0
    with pytest.raises(hd.HDUnavailable):
        comoments.fit(comoments.summed(nobody))
    same(comoments.fit(comoments.summed(reference).unionByName(comoments.summed(nobody))), hd.fit(reference, age_column=None))


def test_references_scan_each_table_once(spark, tmp_path):
    from cohortspan.operators import quality
    from cohortspan.schemas import REFERENCES
    from cohortspan.tables import scan_tables, write_tables

    write_tables(survey_tables(spark, SMALL), str(tmp_path))
    df = quality.foreign_keys(scan_tables(spark, str(tmp_path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    involved = {child for _, child, _, _ in REFERENCES} | {parent for *_, parent in REFERENCES}
    assert plan.count("FileScan") == len(involved) and plan.count("Exchange hashpartitioning") == 1
    assert {r["OrphanRows"] for r in df.collect()} == {0}
