"""Ids of rows, the time they were stored, and what submitters get back."""

import pytest
from conftest import day, make_tables, moment
from pyspark.sql import functions as F

from cohortspan.operators import records, upsert
from cohortspan.operators.ingest import ingest
from cohortspan.schemas import RECORDS, SCHEMAS
from cohortspan.tables import scan_tables, write_tables

AT = "CAST('2024-05-01 10:00:00' AS TIMESTAMP)"
VALUES = [(2, 1, "4", moment("2024-01-02")), (1, 9, "5", moment("2024-01-01")), (1, 1, "6", moment("2024-01-01"))]


def small(spark):
    return make_tables(
        spark,
        [(u, u + 10, None, "M", None) for u in (1, 2, 3)],
        [(1, 1, day("2024-01-01"), True), (2, 2, day("2024-01-02"), False)],
        VALUES,
    )


def test_ids_follow_the_natural_key_however_rows_are_dealt(spark):
    t = small(spark)
    for parts in (1, 3):
        found = records.as_record(t.measurements.repartition(parts), "measurements", "TakenAt").collect()
        ids = {(r["SessionID"], r["BiomarkerID"]): r["MeasurementID"] for r in found}
        assert ids == {(1, 1): 1, (1, 9): 2, (2, 1): 3}
        assert all(r["CreatedAt"] == r["TakenAt"] for r in found)


def test_rows_keep_the_id_and_time_they_have(spark):
    given = small(spark).measurements.withColumns(
        {
            "MeasurementID": F.when(F.col("SessionID") == 2, F.lit(5_000_000_000)),
            "CreatedAt": F.when(F.col("SessionID") == 2, F.lit("2020-01-01").cast("timestamp")),
        }
    )
    found = records.as_record(given, "measurements", AT).orderBy("SessionID", "BiomarkerID").collect()
    assert [r["MeasurementID"] for r in found] == [5_000_000_001, 5_000_000_002, 5_000_000_000]
    assert [r["CreatedAt"].year for r in found] == [2024, 2024, 2020]


def test_appended_rows_come_behind_the_stored_ones(spark):
    t = small(spark)
    stored = records.as_record(t.measurements.where("SessionID = 1"), "measurements", AT)
    new = records.append_records(stored, t.measurements.where("SessionID = 2"), "measurements", "2024-06-01 00:00:00")
    assert new.schema.names == RECORDS["measurements"].names
    assert [(r["MeasurementID"], r["SessionID"], str(r["CreatedAt"])) for r in new.collect()] == [(3, 2, "2024-06-01 00:00:00")]
    first = records.append_records(stored.limit(0), t.measurements, "measurements", "2024-06-01 00:00:00")
    assert sorted(r["MeasurementID"] for r in first.collect()) == [1, 2, 3]
    # A table that a column of its own names gets a time and no further id.
    assert records.append_records(t.users, t.users, "users", "2024-06-01 00:00:00").columns == [*SCHEMAS["users"].names, "CreatedAt"]


def test_records_are_written_and_read_back(spark, tmp_path):
    full = records.as_records(small(spark), {"measurements": "TakenAt"}, AT)
    write_tables(full, str(tmp_path / "full"))
    back = scan_tables(spark, str(tmp_path / "full"), records=True)
    for name in SCHEMAS:
        df = getattr(back, name)
        assert df.columns == RECORDS[name].names
        assert sorted(map(str, df.collect())) == sorted(map(str, getattr(full, name).collect()))
    plain = scan_tables(spark, str(tmp_path / "full"))
    assert plain.measurements.columns == SCHEMAS["measurements"].names and plain.measurements.count() == 3
    assert plain.measured().count() == 3

    write_tables(small(spark), str(tmp_path / "plain"))
    without = scan_tables(spark, str(tmp_path / "plain"), records=True).measurements
    assert without.where("MeasurementID IS NULL AND CreatedAt IS NULL").count() == 3


def test_newest_users_by_the_time_they_were_stored(spark):
    t = small(spark)
    times = F.when(F.col("UserID") < 3, F.concat(F.lit("2024-01-0"), F.col("UserID").cast("string")).cast("timestamp"))
    t = t.replace(users=t.users.withColumn("CreatedAt", times))
    for size, wanted in ((1, [2]), (2, [1, 2]), (3, [1, 2, 3])):  # the user without a time comes last
        sample = upsert.sample_subset(t, size=size)
        assert sorted(r["UserID"] for r in sample.users.collect()) == wanted
    one = upsert.sample_subset(t, size=1)
    assert one.sessions.count() == 1 and one.measurements.count() == 1


@pytest.mark.parametrize("stored_values", [0, 3])
def test_replies_name_the_visit_and_its_values(spark, stored_values):
    t = small(spark)
    headers = spark.createDataFrame(
        [(7, 3, "2024-03-01", True), (8, 3, "2024-03-02", True), (9, 99, "2024-03-02", True)],
        "SubmissionID BIGINT, UserID INT, SessionDateText STRING, FastingStatus BOOLEAN",
    )
    values = spark.createDataFrame([(7, 2, "1"), (7, 1, "2")], "SubmissionID BIGINT, BiomarkerID INT, Value STRING")
    done = ingest(headers, values.withColumn("Value", F.col("Value").cast("decimal(12,4)")), t.users, t.sessions, t.biomarkers)
    stored = records.as_record(t.measurements.limit(stored_values), "measurements", AT)
    found = records.replies(done, stored, "2024-06-01 00:00:00").orderBy("SubmissionID").collect()
    first = stored_values + 1
    assert [(r["SubmissionID"], r["sessionId"], r["measurementIds"]) for r in found] == [(7, 3, [first, first + 1]), (8, 4, [])]
