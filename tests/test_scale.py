"""Numbering, hot groups and the shape of plans."""

import pytest
from conftest import SMALL, make_tables
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspan.functions import ordinals
from cohortspan.functions.ordinals import dense_ordinal
from cohortspan.operators import etl, pheno, quality, queries, relational, series, views
from cohortspan.plans.registry import queries as registered
from cohortspan.session import scratch, shared_folder, sized_settings
from cohortspan.sources.star import survey_tables
from cohortspan.tables import scan_tables, write_tables

_QUIET = [HealthCheck.function_scoped_fixture]


@settings(max_examples=8, deadline=None, suppress_health_check=_QUIET)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=60, unique=True), st.integers(1, 9))
def test_ordinals_equal_a_plain_count(spark, pairs, start):
    df = spark.createDataFrame(pairs, "g INT, v INT")
    levels = [F.floor(F.col("v") / 10), F.floor(F.col("v") / 3)]
    found = {(r["g"], r["v"]): r["n"] for r in dense_ordinal(df, "n", ["g"], levels, [F.col("v")], start).collect()}
    # The second level is not nested in the first (a block of three crosses a ten), which is allowed.
    expected = {(g, v): start + sum(1 for a, b in pairs if a == g and b < v) for g, v in pairs}
    assert found == expected


@settings(max_examples=4, deadline=None, suppress_health_check=_QUIET)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**62), 2**62)), min_size=1, max_size=40))
def test_ids_are_consecutive_in_key_order(spark, keys):
    rows = etl.assign_ids(spark.createDataFrame([(k,) for k in keys], "k BIGINT"), "id", ["k"], 5).collect()
    assert sorted(r["id"] for r in rows) == list(range(5, 5 + len(keys)))
    in_order = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["id"])] == in_order


def test_ids_of_rows_that_share_a_key(spark):
    df = spark.range(2000).selectExpr(
        "CAST(CASE WHEN id % 3 = 0 THEN 70000 ELSE id * 50 END AS INT) AS k", "date_add(DATE '2000-01-01', CAST(id AS INT)) AS d"
    )
    rows = etl.assign_ids(df, "id", ["k", "d"]).collect()
    expected = sorted((r["k"], r["d"]) for r in rows)
    assert [(r["k"], r["d"]) for r in sorted(rows, key=lambda r: r["id"])] == expected
    assert sorted(r["id"] for r in rows) == list(range(1, 2001))


def test_numbering_reads_its_input_once_and_splits_one_key(spark, monkeypatch):
    seen, stored = spark.sparkContext.accumulator(0), []
    cut = ordinals.cut_lineage
    monkeypatch.setattr(ordinals, "cut_lineage", lambda df, label: stored.append(cut(df, label)) or stored[-1])

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(20_000).selectExpr("7 AS k", "id AS v").mapInArrow(counted, "k int, v bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = etl.assign_ids(df, "id", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["id"] for r in rows.collect()) == list(range(1, 20_001))
    assert seen.value == 20_000
    # Equal keys alone would all be in one task of the sort.
    per_task = [r["count"] for r in stored[1].groupBy("__id_part").count().collect()]
    assert len(per_task) > 1 and max(per_task) < 10_000


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100_003).cast("int").alias("k"))
    one = etl.assign_ids(df.coalesce(1), "id", ["k"]).collect()
    many = etl.assign_ids(df.repartition(13), "id", ["k"]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


@pytest.fixture(scope="module")
def hot(spark):
    """One user with a third of all visits and measurements, and one biomarker with most values."""
    n = 6000
    user = "CASE WHEN id % 3 = 0 THEN 1 ELSE CAST(2 + id % 500 AS INT) END"
    visits = spark.range(n).selectExpr(
        "CAST(id + 1 AS INT) AS SessionID",
        f"CAST({user} AS INT) AS UserID",
        "date_add(DATE '1990-01-01', CAST(id AS INT)) AS SessionDate",
        "id % 2 = 0 AS FastingStatus",
    )
    values = visits.selectExpr(
        "SessionID",
        "CAST(CASE WHEN SessionID % 5 = 0 THEN 2 ELSE 1 END AS INT) AS BiomarkerID",
        "CAST(SessionID AS DECIMAL(12,4)) AS Value",
        "CAST(SessionDate AS TIMESTAMP) AS TakenAt",
    )
    users = visits.select("UserID").distinct().selectExpr(
        "UserID", "UserID AS SEQN", "DATE '1980-01-01' AS BirthDate", "'M' AS Sex", "'g' AS RaceEthnicity"
    )
    return make_tables(spark).replace(users=users, sessions=visits, measurements=values)


def test_settings_follow_the_size():
    settings = sized_settings(100 * 2**40)
    assert settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(100 * 2**40 // (128 * 2**20))
    assert sized_settings(1)["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "200"


def test_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return self.value

    class Context:
        applicationId = "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    Session.conf.value, Context.master = "hdfs://host/shared/", "yarn"
    assert scratch(Session, "x").startswith("hdfs://host/shared/cohortspan/x-")
    Session.conf.value = None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    Context.master = "local[2]"
    assert shared_folder(Session) == shared_folder(Session)


def test_hot_user_latest(hot):
    rows = hot.measurements.join(hot.sessions, "SessionID").toPandas()
    newest = rows.sort_values("TakenAt").groupby(["UserID", "BiomarkerID"]).tail(1)
    expected = sorted(zip(newest["UserID"], newest["BiomarkerID"], newest["Value"]))
    found = views.latest_measurements(hot).select("UserID", "BiomarkerID", "Value").collect()
    assert sorted(map(tuple, found)) == expected


def test_hot_user_ordinals(hot):
    rows = series.session_ordinal(hot).toPandas().sort_values(["UserID", "SessionDate"])
    assert (rows["Ordinal"] == rows.groupby("UserID").cumcount() + 1).all()
    assert rows["Ordinal"].max() >= 2000


def test_hot_user_counts(hot):
    rows = {r["userId"]: r["sessionCount"] for r in queries.list_users(hot, "2024-01-01").collect()}
    assert rows[1] == 2000
    joined = {r["BiomarkerID"]: r["MeasurementCount"] for r in quality.five_table_join(hot).collect()}
    assert joined[1] == 4800 and joined[2] == 1200


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_reduces_before_the_shuffle(hot):
    text = plan(views.latest_measurements(hot))
    partial, exchange = text.index("Partial"), text.index("hashpartitioning(UserID")
    assert "WindowGroupLimit" in text and exchange < partial  # the plan is printed from the top


def test_built_in_catalogs_are_broadcast_whatever_the_threshold(spark, hot, tmp_path):
    t = make_tables(spark).replace(users=hot.users, sessions=hot.sessions, measurements=hot.measurements)
    write_tables(t, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (queries.range_comparison(hot), pheno.linear(views.latest_measurements(hot), hot.coefficients)):
            text = plan(df)
            assert "BroadcastHashJoin [BiomarkerID" in text
            assert "hashpartitioning(BiomarkerID" not in text
            assert "SortMergeJoin [SessionID" in text
        # Stored catalogs are left to Spark, which goes by their bytes.
        stored = scan_tables(spark, str(tmp_path))
        assert "BroadcastHashJoin" not in plan(queries.range_comparison(stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_catalogs_carry_no_hint(hot, spark, tmp_path):
    write_tables(make_tables(spark).replace(users=hot.users, sessions=hot.sessions, measurements=hot.measurements), str(tmp_path))
    for _, df in scan_tables(spark, str(tmp_path)).items():
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_trend_and_topk_reduce_before_the_shuffle(hot):
    assert "WindowGroupLimit" in plan(queries.trend(hot, "2006-06-01", within="20 years"))
    top = relational.topk_per_group(hot.measurements, ["BiomarkerID"], [F.col("Value").desc()], 5)
    assert "WindowGroupLimit" in plan(top)


def test_user_filter_moves_below_the_window(spark):
    df = views.latest_measurements(survey_tables(spark, SMALL)).where("UserID = 7")
    text = plan(df)
    scans = [line for line in text.splitlines() if "FileScan" in line and "orders" in line]
    assert scans and all("DataFilters: [" in line and "o_custkey" in line for line in scans)


def test_filters_reach_stored_tables(hot, spark, tmp_path):
    write_tables(hot, str(tmp_path))
    t = scan_tables(spark, str(tmp_path))
    text = plan(queries.user_profile(t, "2024-01-01").where("userId = 7"))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert sum("EqualTo(UserID,7)" in line for line in scans) == 2  # users and measurements
    for df in (views.latest_measurements(t).where("UserID = 7"), queries.trend(t, "2006-06-01").where("userId = 7")):
        scans = [line for line in plan(df).splitlines() if "FileScan" in line and "Value#" in line]
        assert scans and all("EqualTo(UserID,7)" in line for line in scans)
    text = plan(queries.trend(t, "2006-06-01", within="1 year"))
    assert "GreaterThan(SessionDate,2005-06-01)" in text
    measured = next(line for line in text.splitlines() if "FileScan" in line and "Value#" in line)
    read = measured.split("ReadSchema: struct<")[1]
    assert "TakenAt" not in read and "Value:decimal(12,4)" in read


def test_stored_tables_answer_like_the_given_ones(hot, spark, tmp_path):
    write_tables(hot, str(tmp_path))
    t = scan_tables(spark, str(tmp_path))
    for ask in (views.latest_measurements, lambda x: queries.trend(x, "2006-06-01", within="20 years"), queries.session_details):
        assert sorted(map(tuple, ask(t).collect())) == sorted(map(tuple, ask(hot).collect()))
    assert t.measurements.columns == hot.measurements.columns


def test_scans_read_only_needed_columns(spark):
    text = plan(queries.measurement_summary(survey_tables(spark, SMALL)))
    lines = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert lines and all("l_orderkey" in line and "l_shipdate" not in line for line in lines)


NO_PRODUCT = [
    name
    for name in sorted(registered())
    if name not in ("q04_ingest_stream", "read_xpt", "append_results")  # only read back what they wrote
]


@pytest.mark.parametrize("name", NO_PRODUCT)
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(registered()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
