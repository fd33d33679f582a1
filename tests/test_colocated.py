"""Tables bucketed alike: loads move the staged rows and nothing else."""

import re
import uuid

import pytest
from conftest import day, make_tables, moment
from pyspark.sql import functions as F

from cohortspan.operators import etl
from cohortspan.tables import bucket_count, register_colocated, write_colocated

BUCKETS = 4


def exchanges(spark, df):
    """Exchanges of the plan, without broadcasts and before it adapts; and the tables that one stands on."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copy = df.select("*")
        plan = copy._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return len(re.findall(r"(?<!\], )\bExchange (?:hash|range|Single|Round)", plan)), plan  # not those used again


@pytest.fixture(scope="module")
def given(spark):
    users = [(k, 100 + k, day("1980-01-01"), "M", "g") for k in range(1, 60)]
    sessions = [(k, k, day("2024-01-01"), True) for k in range(1, 60)] + [(100 + k, 7, day(f"2023-01-{k:02d}"), True) for k in range(1, 29)]
    values = [(k, 1, "4.5", moment("2024-01-01 09:00:00")) for k in range(1, 30)]
    return make_tables(spark, users, sessions, values)


@pytest.fixture(scope="module")
def stored(spark, given, tmp_path_factory):
    prefix = f"t_{uuid.uuid4().hex}"
    folder = str(tmp_path_factory.mktemp("colocated"))
    return folder, prefix, write_colocated(given, folder, prefix, BUCKETS)


STAGED = "SEQN INT, SessionDate DATE, BiomarkerID INT, Value DOUBLE, TakenAt DATE"


def staged_values(spark):
    rows = [(100 + k, day("2024-01-01"), b, 4.0 + b, day("2024-01-01")) for k in range(1, 61) for b in (1, 2)]
    rows += [(107, day("2023-01-05"), 3, 1.0, day("2023-01-05"))] * 50 + [(107, day("2023-02-05"), 3, 1.0, day("2023-02-05"))]
    return spark.createDataFrame(rows, STAGED)


def test_loads_equal_those_of_plain_tables(spark, given, stored):
    _, _, t = stored
    staged = staged_values(spark)
    plain = etl.load_measurements(staged, given.users, given.sessions, given.measurements)
    found = etl.load_measurements(staged, t.users, t.sessions, t.measurements, BUCKETS)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    visits = staged.select("SEQN", "SessionDate", F.lit(1).alias("FastingStatus"))
    visits = visits.unionByName(visits.withColumn("FastingStatus", F.lit(0)))
    plain = etl.load_sessions(visits, given.users, given.sessions)
    found = etl.load_sessions(visits, t.users, t.sessions, BUCKETS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) == [(7, day("2023-02-05"), False)]


def test_stored_visits_and_values_are_not_exchanged(spark, stored):
    _, _, t = stored
    staged = staged_values(spark)
    count, plan = exchanges(spark, etl.load_measurements(staged, t.users, t.sessions, t.measurements, BUCKETS))
    # Staged rows and participant numbers meet, then the staged rows go to their users.
    assert count == 3, plan
    assert plan.count("Bucketed: true") >= 2
    count, plan = exchanges(spark, etl.load_sessions(staged.selectExpr("SEQN", "SessionDate", "1 AS FastingStatus"), t.users, t.sessions, BUCKETS))
    assert count <= 6, plan


def test_another_session_can_use_them(spark, stored):
    folder, prefix, t = stored
    other = f"t_{uuid.uuid4().hex}"
    found = register_colocated(spark, folder, other, BUCKETS)
    assert bucket_count(spark, other) == bucket_count(spark, prefix) == BUCKETS
    for name in ("users", "sessions", "measurements"):
        assert sorted(map(tuple, getattr(found, name).collect()), key=str) == sorted(map(tuple, getattr(t, name).collect()), key=str)
    count, plan = exchanges(spark, found.sessions.join(found.measurements, ["UserID", "SessionID"]))
    assert count == 0, plan


def test_registered_loads_need_few_exchanges(spark):
    from conftest import SMALL

    from cohortspan.plans.registry import queries

    for name in ("load_measurements", "load_sessions"):
        count, plan = exchanges(spark, queries()[name](spark, SMALL))
        assert count <= 6, (name, plan)
