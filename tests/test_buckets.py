"""Bucketed tables: an upsert rewrites the buckets it touches and no others."""

from pathlib import Path

import pytest
from conftest import day, make_tables
from pyspark.sql import functions as F

from cohortspan.operators import buckets, etl, upsert
from cohortspan.schemas import SESSION, USER


def visits(spark, first, last, fasting="true", start_id=1):
    """One visit of each user, ids in the order of users."""
    return spark.range(first, last).selectExpr(
        f"CAST(id - {first} + {start_id} AS INT) AS SessionID", "CAST(id AS INT) AS UserID", "DATE '2024-01-01' AS SessionDate",
        f"{fasting} AS FastingStatus",
    )


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("bucket=*/part-*")}


@pytest.fixture()
def table(spark, tmp_path):
    return buckets.create(spark, str(tmp_path / "sessions"), visits(spark, 0, 400), ["UserID"], 16, "SessionID")


def test_untouched_files_stay(spark, table):
    before = files(f"{table.folder}/rows")
    assert {name.split("/")[0] for name in before} == {f"bucket={k}" for k in range(16)}
    incoming = visits(spark, 7, 9, "false").drop("SessionID")
    touched = {r[0] for r in incoming.select(table.bucket()).distinct().collect()}
    buckets.upsert_named(table, "sessions", incoming)
    after = files(f"{table.folder}/rows")
    same = {name for name in before if int(name.split("/")[0][7:]) not in touched}
    assert same and {name: after.get(name) for name in same} == {name: before[name] for name in same}
    assert not {name for name in before if name in after} - same
    changed = {r["UserID"] for r in table.read().where("NOT FastingStatus").collect()}
    assert changed == {7, 8} and table.read().count() == 400


def test_the_whole_table_equals_a_plain_upsert(spark, table):
    incoming = visits(spark, 350, 460, "id % 2 = 0").drop("SessionID")
    incoming = incoming.unionByName(incoming.where("UserID < 360").withColumn("FastingStatus", F.lit(None).cast("boolean")))
    plain = etl.fill_ids(upsert.upsert(table.read(), incoming, ["UserID", "SessionDate"], ["FastingStatus"]), "SessionID", ["UserID", "SessionDate"])
    wanted = sorted(map(tuple, plain.collect()))
    done = buckets.upsert_named(table, "sessions", incoming)
    assert sorted(map(tuple, done.read().collect())) == wanted
    assert done.highest == 460 and sorted(r[0] for r in wanted) == list(range(1, 461))
    again = buckets.upsert_named(done, "sessions", incoming)
    assert sorted(map(tuple, again.read().collect())) == wanted and again.highest == 460


def test_a_table_is_opened_as_it_was_left(spark, table):
    buckets.upsert_named(table, "sessions", visits(spark, 500, 510).drop("SessionID"))
    found = buckets.open_table(spark, table.folder, SESSION)
    assert (found.by, found.count, found.highest) == (("UserID",), 16, 410)
    done = buckets.upsert_named(found, "sessions", visits(spark, 510, 512).drop("SessionID"))
    assert sorted(r["SessionID"] for r in done.read().where("UserID >= 500").collect()) == list(range(401, 413))


def test_publishing_again_after_a_loss(spark, table):
    rows, highest = buckets.merged(table, visits(spark, 3, 5, "false").drop("SessionID"), ["UserID", "SessionDate"], ["FastingStatus"], ids=buckets.IDS["sessions"])
    # As if the job had been lost after old directories went and before new ones came.
    for r in rows.select("bucket").distinct().collect():
        for path in Path(table.folder, "rows", f"bucket={r[0]}").glob("*part-*"):
            path.unlink()
    assert table.read().count() < 400
    done = buckets.publish(table, rows, highest)
    assert done.read().count() == 400 and done.read().where("NOT FastingStatus").count() == 2


def test_keys_with_nulls_are_never_the_same(spark, tmp_path):
    users = make_tables(spark, [(1, 11, day("1980-01-01"), "M", "a"), (2, None, None, "F", "b")]).users
    table = buckets.create(spark, str(tmp_path / "users"), users, ["SEQN"], 4, "UserID")
    incoming = spark.createDataFrame(
        [(None, None, "F", "c"), (None, None, "F", "c"), (11, None, "M", "d"), (10, None, "M", "e")],
        "SEQN BIGINT, BirthDate DATE, Sex STRING, RaceEthnicity STRING",
    )
    rows = buckets.upsert_named(table, "users", incoming).read()
    assert rows.schema == USER or [f.name for f in rows.schema] == [f.name for f in USER]
    assert sorted(((r["UserID"], r["SEQN"], r["RaceEthnicity"]) for r in rows.collect())) == [
        (1, 11, "d"), (2, None, "b"), (3, None, "c"), (4, None, "c"), (5, 10, "e"),
    ]


def test_an_empty_batch_changes_nothing(spark, table):
    before = files(f"{table.folder}/rows")
    done = buckets.upsert_named(table, "sessions", visits(spark, 0, 0).drop("SessionID"))
    assert files(f"{table.folder}/rows") == before and done.highest == 400


def test_buckets_must_follow_from_the_key(spark, table):
    with pytest.raises(ValueError):
        buckets.upsert_into(table, visits(spark, 0, 1), ["SessionDate"], ["FastingStatus"])


def test_only_touched_buckets_are_read(spark, table):
    scan = table.rows([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "bucket#" in scan.split("PartitionFilters")[1][:60]
    assert table.rows([3, 5]).select("bucket").distinct().count() == 2
