import json
import os

import pytest
from conftest import day, make_tables, moment
from pyspark.sql import Row

from cohortspan.operators.ingest import flatten, ingest
from cohortspan.streaming.arrivals import FirstDelivery, VisitsOfUser, ingest_stream

HEADER = "SubmissionID BIGINT, UserID INT, SessionDateText STRING, FastingStatus BOOLEAN"
VALUE = "SubmissionID BIGINT, BiomarkerID INT, Value STRING"

HEADERS = [
    (1, 1, "2024-12-25", True),  # accepted
    (2, 1, "2024-12-25", True),  # second for the day
    (3, 1, "2024-01-01", True),  # stored already
    (4, 9, "2024-02-01", True),  # nobody
    (5, 2, "2024-02-30", True),  # no such day
    (6, 2, "20240201", True),  # not in the expected form
    (7, 2, None, True),
    (8, 2, "", True),
    (9, 2, "2024-02-01", None),
    (10, 2, "2024-02-02", False),  # unknown biomarker
    (11, 2, "2024-02-02", False),  # accepted, since the one before fails
    (12, 2, "2024-02-03", False),  # missing value
    (13, 2, "2024-02-04", False),  # repeated biomarker
    (14, 2, "2024-02-05", False),  # no values at all: accepted
    (15, 2, "2024-02-02", True),  # unknown biomarker, but the day is taken by then
    (16, 2, "2024-02-06", True),  # does not fit the column
]
VALUES = [
    *[(i, 1, "4.5") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)],
    (10, 77, "1"),
    (11, 2, "65.12345"),
    (12, 2, None),
    (13, 1, "4.6"),
    (15, 77, "1"),
    (16, 1, "123456789012"),
]
REASONS = {
    2: "duplicate_session",
    3: "duplicate_session",
    4: "unknown_user",
    5: "invalid_date",
    6: "invalid_date",
    7: "invalid_value",
    8: "invalid_value",
    9: "invalid_value",
    10: "unknown_biomarker",
    12: "null_value",
    13: "repeated_biomarker",
    15: "duplicate_session",
    16: "null_value",
}


@pytest.fixture(scope="module")
def tables(spark):
    users = [(1, 11, day("1980-01-01"), "M", "g"), (2, 12, day("1990-01-01"), "F", "g")]
    return make_tables(spark, users, [(40, 1, day("2024-01-01"), True)])


def test_every_submission_is_accepted_or_explained(spark, tables):
    done = ingest(
        spark.createDataFrame(HEADERS, HEADER),
        spark.createDataFrame(VALUES, VALUE),
        tables.users,
        tables.sessions,
        tables.biomarkers,
        "2025-01-01 10:30:15",
    )
    assert {r["SubmissionID"]: r["Reason"] for r in done.rejected.collect()} == REASONS
    accepted = {r["SubmissionID"]: r for r in done.sessions.collect()}
    assert {s: r["SessionID"] for s, r in accepted.items()} == {1: 41, 11: 42, 14: 43}
    assert len(accepted) + len(REASONS) == len(HEADERS)
    rows = {(r["SessionID"], r["BiomarkerID"]): r for r in done.measurements.collect()}
    assert sorted(rows) == [(41, 1), (42, 1), (42, 2)]
    assert str(rows[(42, 2)]["Value"]) == "65.1235"
    assert rows[(41, 1)]["TakenAt"] == moment("2024-12-25 10:30:15")


def test_ingesting_again_accepts_nothing(spark, tables):
    headers, values = spark.createDataFrame(HEADERS, HEADER), spark.createDataFrame(VALUES, VALUE)
    first = ingest(headers, values, tables.users, tables.sessions, tables.biomarkers)
    stored = tables.sessions.unionByName(first.sessions.drop("SubmissionID"))
    again = ingest(headers, values, tables.users, stored, tables.biomarkers)
    assert again.sessions.count() == 0 and again.measurements.count() == 0
    assert again.rejected.count() == len(HEADERS)


def test_one_day_with_a_third_of_all_submissions(spark, tables):
    n = 3000
    headers = spark.range(n).selectExpr(
        "id AS SubmissionID",
        "CAST(1 + id % 2 AS INT) AS UserID",
        "CASE WHEN id % 3 = 0 THEN '2024-07-01' ELSE CAST(date_add(DATE '2010-01-01', CAST(id AS INT)) AS STRING) END"
        " AS SessionDateText",
        "true AS FastingStatus",
    )
    values = headers.selectExpr("SubmissionID", "1 AS BiomarkerID", "'4.5' AS Value")
    done = ingest(headers, values, tables.users, tables.sessions, tables.biomarkers)
    crowded = done.sessions.where("SessionDate = DATE '2024-07-01'").collect()
    assert sorted((r["UserID"], r["SubmissionID"]) for r in crowded) == [(1, 0), (2, 3)]
    reasons = {r["Reason"]: r["count"] for r in done.rejected.groupBy("Reason").count().collect()}
    assert reasons == {"duplicate_session": n // 3 - 2}
    assert done.sessions.count() == n - n // 3 + 2


def write_bodies(folder, name, headers, values):
    lines = []
    for number, user, date, fasting in headers:
        listed = [{"biomarkerId": b, "value": v and float(v)} for n, b, v in values if n == number]
        body = {"SubmissionID": number, "UserID": user, "sessionDate": date, "fastingStatus": fasting}
        lines.append(json.dumps({**body, "measurements": listed}))
    (folder / name).write_text("\n".join(lines) + "\n")


def test_a_submission_delivered_again_is_decided_once(spark, tables):
    headers = [(1, 1, "2024-12-25", True)] * 3 + [(2, 2, "2024-12-25", True), (2, 2, "2024-12-26", True)]
    headers += [(None, 1, "2024-12-27", True), (None, 1, "2024-12-27", True), (3, 2, "2024-12-28", True)]
    values = [(1, 1, "4.5"), (1, 2, "65")] * 3 + [(2, 1, "4.4")] * 2 + [(3, 1, "4.4"), (3, 1, "4.4")]
    done = ingest(
        spark.createDataFrame(headers, HEADER),
        spark.createDataFrame(values, VALUE),
        tables.users,
        tables.sessions,
        tables.biomarkers,
    )
    assert [(r["SubmissionID"], r["SessionID"]) for r in done.sessions.collect()] == [(1, 41)]
    assert sorted((r["SessionID"], r["BiomarkerID"]) for r in done.measurements.collect()) == [(41, 1), (41, 2)]
    reasons = sorted(((r["SubmissionID"] or 0, r["Reason"]) for r in done.rejected.collect()))
    assert reasons == [(0, "invalid_value"), (0, "invalid_value"), (2, "conflicting_submission"), (3, "repeated_biomarker")]


@pytest.mark.parametrize("seed", range(3))
def test_accepted_and_rejected_make_the_input(spark, tables, seed):
    import random

    rng = random.Random(seed)
    headers = [
        (rng.choice([None, *range(12)]), rng.choice([1, 2, 9, None]), rng.choice(["2024-07-01", "2024-07-02", "x", None]), rng.choice([True, None]))
        for _ in range(40)
    ]
    values = [(rng.randrange(12), rng.choice([1, 2, 77, None]), rng.choice(["4", None])) for _ in range(20)]
    done = ingest(
        spark.createDataFrame(headers, HEADER), spark.createDataFrame(values, VALUE), tables.users, tables.sessions, tables.biomarkers
    )
    accepted = [r["SubmissionID"] for r in done.sessions.collect()]
    rejected = [r["SubmissionID"] for r in done.rejected.collect()]
    ids = [h[0] for h in headers]
    assert sorted(accepted + [x for x in rejected if x is not None]) == sorted({x for x in ids if x is not None})
    assert rejected.count(None) == ids.count(None)
    days = [(r["UserID"], r["SessionDate"]) for r in done.sessions.collect()]
    assert len(days) == len(set(days))


def test_a_body_without_a_list_is_rejected(spark, tables):
    bodies = spark.createDataFrame(
        [
            (1, 1, "2024-12-25", True, None),
            (2, 1, "2024-12-26", True, []),
            (3, 1, "2024-12-27", True, [(1, "4.5")]),
        ],
        "SubmissionID BIGINT, UserID INT, sessionDate STRING, fastingStatus BOOLEAN, measurements ARRAY<STRUCT<biomarkerId: INT, value: STRING>>",
    )
    done = ingest(*flatten(bodies), tables.users, tables.sessions, tables.biomarkers)
    assert {r["SubmissionID"] for r in done.sessions.collect()} == {2, 3}
    assert [(r["SubmissionID"], r["Reason"]) for r in done.rejected.collect()] == [(1, "invalid_value")]


class Stream:
    """A stream over files that a test adds one by one."""

    def __init__(self, spark, tables, folder, **options):
        self.spark, self.tables, self.options = spark, tables, options
        self.source, self.target, self.checkpoint = folder / "incoming", str(folder / "stored"), str(folder / "checkpoint")
        self.source.mkdir(parents=True)

    def run(self, name=None, headers=(), values=()):
        if name:
            write_bodies(self.source, name, headers, values)
        t = self.tables
        partitions = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store and a worker each
        try:
            ingest_stream(
                self.spark, str(self.source), self.target, t.users, t.sessions, t.biomarkers, self.checkpoint, **self.options
            ).awaitTermination()
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return self

    def rows(self, name):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.target}/{name}").drop("batch").collect()), key=str)


def test_stream_takes_each_submission_once(spark, tables, tmp_path):
    stream = Stream(spark, tables, tmp_path)
    stream.run("a.json", HEADERS[:15], [v for v in VALUES if v[0] != 16])
    assert {r[0] for r in stream.rows("sessions")} == {1, 11, 14}
    assert {r[0]: r[4] for r in stream.rows("rejected")} == {k: v for k, v in REASONS.items() if k != 16}
    stream.run("b.json", [(101, 1, "2024-12-25", True), (102, 1, "2024-12-26", True)], [(101, 1, "4.5"), (102, 1, "4.4")])
    assert {r[0]: r[1] for r in stream.rows("sessions")} == {1: 41, 11: 42, 14: 43, 102: 44}
    assert {r[0]: r[4] for r in stream.rows("rejected")}[101] == "duplicate_session"
    assert sorted((r[1], r[2], str(r[3])) for r in stream.rows("measurements"))[-1] == (44, 1, "4.4000")
    assert all(r[4].hour == 0 for r in stream.rows("measurements"))


def test_a_submission_split_over_deliveries_is_decided_once(spark, tables, tmp_path):
    first = [(1, 1, "2024-12-25", True), (2, 1, "2024-13-01", True), (None, 1, "2024-12-24", True)]
    again = [(1, 1, "2024-12-25", True), (1, 1, "2024-12-26", True), (2, 1, "2024-12-27", True), (None, 1, "2024-12-24", True)]
    stream = Stream(spark, tables, tmp_path).run("a.json", first + first[:1], [(1, 1, "4.5")])
    accepted, rejected = stream.rows("sessions"), stream.rows("rejected")
    assert [(r[0], r[1]) for r in accepted] == [(1, 41)] and [(r[0], r[4]) for r in rejected] == [(2, "invalid_date"), (None, "invalid_value")]
    stream.run("b.json", again, [(1, 1, "4.5")])
    assert stream.rows("sessions") == accepted
    # What has no id can not be told from what came before: it is rejected each time.
    assert [(r[0], r[4]) for r in stream.rows("rejected")] == [(2, "invalid_date"), (None, "invalid_value"), (None, "invalid_value")]
    stream.run("c.json", [(3, 1, "2024-12-28", True), (3, 2, "2024-12-28", True), (4, 2, "2024-12-28", False)], [(4, 2, "60")])
    assert [(r[0], r[1]) for r in stream.rows("sessions")] == [(1, 41), (4, 42)]
    assert (3, "conflicting_submission") in [(r[0], r[4]) for r in stream.rows("rejected")]


def test_a_batch_that_is_replayed_writes_the_same_rows(spark, tables, tmp_path):
    stream = Stream(spark, tables, tmp_path)
    stream.run("a.json", HEADERS[:15], VALUES[:-1]).run("b.json", [(101, 1, "2024-12-25", True), (102, 1, "2024-12-26", True)], [(102, 1, "4.4")])
    names = ("sessions", "measurements", "rejected", "highest")
    before = {name: stream.rows(name) for name in names}
    # As if the job had been lost after the batch was written and before it was committed.
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream.run()
    assert {name: stream.rows(name) for name in names} == before
    stream.run("c.json", [(103, 1, "2024-12-26", True), (104, 1, "2024-12-27", True)], [])
    assert max(r[1] for r in stream.rows("sessions")) == 45 and len(stream.rows("sessions")) == 5


def test_batches_of_one_file_decide_like_one_batch(spark, tables, tmp_path):
    one, many = (Stream(spark, tables, tmp_path / name, **options) for name, options in (("one", {}), ("many", {"max_files": 1})))
    for folder in (one, many):
        for k in range(3):
            write_bodies(folder.source, f"{k}.json", HEADERS[5 * k : 5 * k + 5], VALUES[:-1])
            # Files are read in the order of their times.
            os.utime(folder.source / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)
        folder.run()
    assert one.rows("sessions") == many.rows("sessions") and one.rows("rejected") == many.rows("rejected")
    assert len(list((tmp_path / "many" / "stored" / "highest").glob("batch=*"))) == 3


def test_users_who_register_later(spark, tables, tmp_path):
    registered = tmp_path / "users"
    registered.mkdir()
    registrations = spark.readStream.schema("UserID INT").parquet(str(registered))
    stream = Stream(spark, tables, tmp_path, registrations=registrations)
    stream.run("a.json", [(1, 9, "2024-12-25", True)], [])
    assert [(r[0], r[4]) for r in stream.rows("rejected")] == [(1, "unknown_user")]
    spark.createDataFrame([(9,), (10,)], "UserID INT").write.mode("append").parquet(str(registered))
    stream.run("b.json", [(2, 9, "2024-12-25", True), (3, 11, "2024-12-25", True)], [])
    assert [(r[0], r[1], r[2]) for r in stream.rows("sessions")] == [(2, 41, 9)]
    assert (3, "unknown_user") in [(r[0], r[4]) for r in stream.rows("rejected")]


def test_batches_read_no_stored_table(spark, tables, tmp_path):
    stored = str(tmp_path / "tables")
    tables.users.write.parquet(f"{stored}/users")
    tables.sessions.write.parquet(f"{stored}/sessions")
    held = tables.replace(users=spark.read.parquet(f"{stored}/users"), sessions=spark.read.parquet(f"{stored}/sessions"))
    stream = Stream(spark, held, tmp_path).run("a.json", HEADERS[:3], VALUES[:3])
    # With its state, the stream goes on when the tables are empty.
    empty = tables.replace(users=tables.users.limit(0), sessions=tables.sessions.limit(0))
    stream.tables = empty
    stream.run("b.json", [(50, 2, "2024-12-25", True), (51, 1, "2024-01-01", True), (52, 1, "2024-12-25", True)], [])
    assert [(r[0], r[1]) for r in stream.rows("sessions")] == [(1, 41), (50, 42)]
    assert {r[0]: r[4] for r in stream.rows("rejected")} == {2: "duplicate_session", 3: "duplicate_session", 51: "duplicate_session", 52: "duplicate_session"}


class Counted:
    """A state value that counts the calls on it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_the_state_is_called_twice_for_a_block_whatever_it_brings():
    first, visits = FirstDelivery(), VisitsOfUser()
    decided, visited = Counted(), Counted()
    first.init(decided), visits.init(visited)
    bodies = [Row(Place=k % 500, Body=f"{k % 500}" if k % 5 else f"{k}") for k in range(1000)]
    out = list(first.handleInputRows((0, -1), iter(bodies), None))
    assert len(out) == 500 and sum(r["Conflict"] for r in out) == 100 and decided.calls == 2
    assert list(first.handleInputRows((0, -1), iter(bodies), None)) == [] and decided.calls == 3
    visits.handleInitialState((0, -1), Row(Users=[1, 2], Visits=[7 << 4 | 1]), None)
    sent = [Row(Place=k % 4, Kind="submission", SubmissionID=k, Day=k // 4, Own=None, Body=str(k)) for k in range(400)]
    reasons = [r["Reason"] for r in visits.handleInputRows((0, -1), iter(sent), None)]
    assert reasons.count("unknown_user") == 200 and reasons.count(None) == 199 and reasons[4 * 7 + 1] == "duplicate_session"
    assert visited.calls == 3 and len(visited.value[1]) == 200


def test_ids_of_any_size_have_a_block(spark, tables, tmp_path):
    ids = [-(2**63), -1, 0, 1023, 1024, 2**53, 2**53 + 1, 2**63 - 1]
    headers = [(n, 1 + k % 2, f"2024-03-{k + 1:02d}", True) for k, n in enumerate(ids)]
    stream = Stream(spark, tables, tmp_path).run("a.json", headers, [])
    assert sorted(r[0] for r in stream.rows("sessions")) == ids
    stream.run("b.json", headers + [(2**53 + 2, 1, "2024-04-01", True)], [])
    assert sorted(r[0] for r in stream.rows("sessions")) == sorted([*ids, 2**53 + 2]) and stream.rows("rejected") == []
