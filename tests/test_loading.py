import pytest
from conftest import day, make_tables, moment, nine_values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspan import catalog
from cohortspan.operators import etl, quality, upsert
from cohortspan.sources import csvfiles, samples, xpt

DEMO = "SEQN DOUBLE, RIDAGEYR DOUBLE, RIAGENDR DOUBLE, RIDRETH3 DOUBLE, RIDEXMON DOUBLE"


@pytest.fixture(scope="module")
def demo(spark):
    rows = [
        (1.0, 30.9, 1.0, 3.0, 1.0),
        (2.0, 0.0, 2.0, 7.0, 2.0),
        (3.0, 40.0, 1.0, 5.0, None),  # code 5 has no label
        (4.0, 40.0, 3.0, 1.0, 1.0),  # no such sex
        (5.0, None, 1.0, 1.0, 1.0),
        (None, 20.0, 1.0, 1.0, 1.0),
        (7.0, 20.0, 2.0, 6.0, 9.0),
    ]
    return spark.createDataFrame(rows, DEMO)


def test_users(demo):
    rows = [tuple(r) for r in etl.with_birth_date(etl.clean_users(demo)).orderBy("SEQN").collect()]
    assert rows == [
        (1, day("1988-07-01"), "M", "Non-Hispanic White"),
        (2, day("2018-07-01"), "F", "Other Race - Including Multi-Racial"),
        (7, day("1998-07-01"), "F", "Non-Hispanic Asian"),
    ]


def test_exam_dates(spark, demo):
    people = spark.createDataFrame([(1,), (2,), (3,), (7,), (99,)], "SEQN INT")
    rows = {r["SEQN"]: str(r["d"]) for r in etl.with_exam_date(people, demo, "d").collect()}
    assert rows == {1: "2018-01-15", 2: "2018-07-15", 3: "2018-01-01", 7: "2018-01-01", 99: "2018-01-01"}
    rows = etl.with_exam_date(people, demo.drop("RIDEXMON"), "d").select("d").distinct().collect()
    assert [str(r[0]) for r in rows] == ["2018-01-01"]


def test_fasting(spark):
    rows = [
        (1, "7", "59"), (2, "7", "60"), (3, None, "480"), (4, "refused", "0"), (5, "8", None), (6, "7", "0"), (6, "9", "0"),
    ]
    df = spark.createDataFrame(rows, "SEQN INT, PHAFSTHR STRING, PHAFSTMN STRING")
    found = {r["SEQN"]: r["IsFasted"] for r in etl.fasting_status(df).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
    hours = {r["SEQN"]: r["IsFasted"] for r in etl.fasting_status(df.drop("PHAFSTMN")).collect()}
    assert hours[2] == 0


def test_anthropometry_keeps_rows_without_measures(spark, demo):
    bmx = spark.createDataFrame(
        [(1.0, 70.0, 170.0, 24.2), (2.0, None, None, None), (None, 1.0, 1.0, 1.0)],
        "SEQN DOUBLE, BMXWT DOUBLE, BMXHT DOUBLE, BMXBMI DOUBLE",
    )
    assert etl.clean_anthropometry(bmx, demo).count() == 2


def test_measurements(spark, demo):
    labs = [
        spark.createDataFrame([(1.0, 4.5, None), (2.0, None, 70.0)], "SEQN DOUBLE, LBXSAL DOUBLE, LBXSAPSI DOUBLE"),
        spark.createDataFrame([(1.0, 90.0, 5.0)], "SEQN DOUBLE, LBXGLU DOUBLE, OTHER DOUBLE"),
    ]
    rows = etl.clean_measurements(labs, demo, catalog.biomarkers(spark)).orderBy("SEQN", "BiomarkerID").collect()
    assert [(r["SEQN"], r["BiomarkerID"], r["Value"], str(r["TakenAt"])) for r in rows] == [
        (1, 1, 4.5, "2018-01-15"),
        (1, 4, 90.0, "2018-01-15"),
        (2, 2, 70.0, "2018-07-15"),
    ]


def test_loads_ignore_what_is_there(spark):
    t = make_tables(spark, [(1, 11, None, None, None), (2, 12, None, None, None)], [(5, 1, day("2018-01-15"), False)])
    staged = spark.createDataFrame(
        [
            (11, day("2018-01-15"), 1),
            (12, day("2018-01-15"), 1),
            (12, day("2018-01-15"), 0),
            (99, day("2018-01-15"), 1),
        ],
        "SEQN INT, SessionDate DATE, FastingStatus INT",
    )
    new = etl.load_sessions(staged, t.users, t.sessions)
    assert [tuple(r) for r in new.collect()] == [(2, day("2018-01-15"), False)]
    values = spark.createDataFrame(
        [
            (11, day("2018-01-15"), 1, 4.12345, day("2018-01-15")),
            (11, day("2018-01-16"), 1, 4.0, day("2018-01-16")),  # no visit on that day
            (11, day("2018-01-15"), 2, 1e12, day("2018-01-15")),  # does not fit
        ],
        "SEQN INT, SessionDate DATE, BiomarkerID INT, Value DOUBLE, TakenAt DATE",
    )
    loaded = etl.load_measurements(values, t.users, t.sessions, t.measurements).collect()
    assert [(r["SessionID"], r["BiomarkerID"], str(r["Value"])) for r in loaded] == [(5, 1, "4.1235")]
    assert etl.load_anthropometry(None, t.users, t.anthropometry).count() == 0


def test_upsert_twice_is_upsert_once(spark):
    t = make_tables(spark, [(1, 11, day("1980-01-01"), "M", "a"), (2, 12, day("1981-01-01"), "F", "b")])
    incoming = spark.createDataFrame(
        [(12, None, "M", "c"), (14, day("1990-01-01"), "F", "d"), (13, day("1991-01-01"), "F", "e")],
        "SEQN INT, BirthDate DATE, Sex STRING, RaceEthnicity STRING",
    )
    once = etl.fill_ids(upsert.upsert_users(t.users, incoming), "UserID", ["SEQN"])
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [
        (1, 11, day("1980-01-01"), "M", "a"),
        (2, 12, None, "M", "c"),  # an incoming NULL replaces a value
        (3, 13, day("1991-01-01"), "F", "e"),
        (4, 14, day("1990-01-01"), "F", "d"),
    ]
    twice = etl.fill_ids(upsert.upsert_users(once, incoming), "UserID", ["SEQN"])
    assert sorted(tuple(r) for r in twice.collect()) == rows


def test_upsert_changes_only_named_columns(spark):
    t = make_tables(
        spark,
        [(1, 11, None, None, None)],
        [(5, 1, day("2024-01-01"), True)],
        [(5, 1, "4.0", moment("2024-01-01 08:00:00"))],
    )
    incoming = spark.createDataFrame(
        [
            (11, day("2024-01-01"), 1, 4.5, moment("2024-01-01 12:00:00")),
            (11, day("2024-01-01"), 2, 60.0, moment("2024-01-01 12:00:00")),
        ],
        "SEQN INT, SessionDate DATE, BiomarkerID INT, Value DOUBLE, TakenAt TIMESTAMP",
    )
    rows = upsert.upsert_measurements(t.measurements, incoming, t.users, t.sessions).orderBy("BiomarkerID").collect()
    assert [(str(r["Value"]), r["TakenAt"].hour) for r in rows] == [("4.5000", 8), ("60.0000", 12)]
    repeated = incoming.where("BiomarkerID = 1").unionByName(incoming.where("BiomarkerID = 1").withColumn("Value", F.lit(9.0)))
    keyed = upsert.user_ids(repeated, t.users).join(t.sessions, ["UserID", "SessionDate"]).select(
        "SessionID", "BiomarkerID", "Value", "TakenAt"
    )
    last = upsert.upsert(t.measurements, keyed, ["SessionID", "BiomarkerID"], ["Value"], [F.col("Value").desc()])
    assert [str(r["Value"]) for r in last.collect()] == ["9.0000"]


def test_purge_and_restrict(spark):
    t = make_tables(
        spark,
        [(1, 11, None, None, None), (2, 12, None, None, None)],
        [(1, 1, day("2024-01-01"), True), (2, 2, day("2024-01-01"), True)],
        nine_values(1, "2024-01-01 08:00:00") + nine_values(2, "2024-01-01 08:00:00", b9=None),
        [(1, day("2024-01-01"), None, None, None)],
        [(1, 1, "30", moment("2024-01-01 08:00:00"))],
    )
    kept = upsert.purge_users(t, t.users.where("UserID = 1"))
    assert [getattr(kept, n).count() for n in ("users", "sessions", "measurements", "anthropometry", "results")] == [1, 1, 8, 0, 0]
    with pytest.raises(upsert.Restricted, match="results"):
        upsert.delete_models(t, t.models.where("ModelID = 1"))
    assert upsert.delete_models(t, t.models.where("ModelID = 2")).models.count() == 1
    with pytest.raises(upsert.Restricted):
        upsert.delete_biomarkers(t, t.biomarkers.where("BiomarkerID = 9"))
    bare = kept.replace(ranges=t.ranges.where("BiomarkerID <> 9"), coefficients=t.coefficients.where("BiomarkerID <> 9"))
    assert upsert.delete_biomarkers(bare, t.biomarkers.where("BiomarkerID = 9")).biomarkers.count() == 8


def test_sample_of_newest_users(spark):
    users = [(u, u, None, None, None) for u in range(1, 16)]
    t = make_tables(spark, users, [(u, u, day("2024-01-01"), True) for u in range(1, 16)])
    created = t.users.select("UserID", F.lit("2024-01-01").cast("date").alias("CreatedAt"))
    sample = upsert.sample_subset(t, created)
    assert sorted(r["UserID"] for r in sample.users.collect()) == list(range(6, 16))
    assert sample.sessions.count() == 10


def test_quality_findings(spark):
    t = make_tables(
        spark,
        [(1, 11, None, "M", None), (2, 11, None, "X", None)],
        [(1, 1, day("2024-01-01"), True), (2, 9, day("2024-01-01"), True), (3, 1, day("2024-01-01"), True)],
        [(1, 1, "4", moment("2024-01-01")), (8, 1, "4", moment("2024-01-01")), (8, 55, "4", moment("2024-01-01"))],
    )
    unique = {r["TableName"]: (r["DuplicateKeys"], r["ExtraRows"]) for r in quality.unique_keys_of(t).collect()}
    assert unique["users"] == (1, 1) and unique["sessions"] == (1, 1) and unique["measurements"] == (0, 0)
    orphans = {r["ForeignKey"]: (r["OrphanKeys"], r["OrphanRows"]) for r in quality.foreign_keys(t).collect()}
    assert orphans["fk_session_user"] == (1, 1)
    assert orphans["fk_measurement_session"] == (1, 2)
    assert orphans["fk_measurement_biomarker"] == (1, 1)
    assert len(orphans) == 9 and orphans["fk_range_biomarker"] == (0, 0)
    bad = {(r["ColumnName"], r["Rule"]): r["BadRows"] for r in quality.domains({"users": t.users}).collect()}
    assert bad[("Sex", "not_in_domain")] == 1
    assert quality.columns(dict(t.items())) == []
    assert quality.columns({"users": t.users.drop("Sex").withColumn("SEQN", F.col("SEQN").cast("long"))}) == [
        ("users", "SEQN", "bigint instead of int"),
        ("users", "Sex", "missing"),
    ]
    wrong = t.replace(coefficients=t.coefficients.withColumn(
        "Coefficient", F.when(F.col("BiomarkerID") == 1, F.lit(0.5)).otherwise(F.col("Coefficient")).cast("decimal(10,6)")
    ).where("BiomarkerID <> 2"))
    status = {r["Biomarker"]: r["Status"] for r in quality.coefficients(wrong).collect()}
    assert status["albumin"] == "different" and status["alkaline phosphatase"] == "missing" and status["creatinine"] == "ok"
    order = quality.catalog_order(t.replace(biomarkers=t.biomarkers.where("BiomarkerID <> 3")))
    assert order.where("NOT Ok").count() == 1
    assert quality.five_table_join(t, limit=5).count() == 5


def test_summary_file(spark, tmp_path):
    t = make_tables(spark, [(1, 11, day("2000-01-01"), "M", None)])
    quality.write_summary(t, "2024-01-01", str(tmp_path / "summary"))
    row = spark.read.json(str(tmp_path / "summary")).first()
    assert (row["biomarkers"], row["reference_ranges"], row["models"], row["coefficients"]) == (9, 20, 2, 9)


def test_csv(spark, tmp_path):
    (tmp_path / "users.csv").write_text(
        'SEQN,BirthDate,Sex,RaceEthnicity\n1,1988-07-01,M,"Other, mixed"\n2,,F,x\nthree,1988-07-01,M,x\n4,1988-13-01,M,x\n5,1988-07-01\n'
    )
    good, bad = csvfiles.read_csv(spark, str(tmp_path / "users.csv"), csvfiles.USERS_CSV)
    assert sorted(tuple(r) for r in good.collect()) == [(1, day("1988-07-01"), "M", "Other, mixed"), (2, None, "F", "x")]
    assert good.select("SEQN").count() == 2 and len(good.select("SEQN").collect()) == 2
    assert sorted(r["Line"] for r in bad.collect()) == ["4,1988-13-01,M,x", "5,1988-07-01", "three,1988-07-01,M,x"]


def test_ranges_file(spark, tmp_path):
    path = str(tmp_path / "ranges")
    csvfiles.write_ranges(catalog.ranges(spark, "etl"), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert len(lines) == 23 and sum(line.startswith("#") for line in lines) == 3
    back = csvfiles.read_ranges(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, catalog.ranges(spark, "etl").collect()))
    stored = csvfiles.replace_ranges(catalog.ranges(spark, "seed"), str(tmp_path / "stored"))
    assert stored.count() == 20
    replaced = csvfiles.replace_ranges(back, str(tmp_path / "stored"))
    assert sorted(map(tuple, replaced.collect())) == sorted(map(tuple, back.collect()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(min_value=-1e60, max_value=1e60, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-60), min_size=1))
def test_ibm_floats(values):
    import numpy as np

    array = np.array(values)
    assert (xpt.ibm_to_double(samples.double_to_ibm(array)) == array).all()


def test_ibm_float_patterns():
    import numpy as np

    raw = np.array([[0x41, 0x10, 0, 0], [0xC1, 0x18, 0, 0], [0x42, 0x64, 0, 0], [0, 0, 0, 0], [0x2E, 0, 0, 0], [0x41, 0x2E, 0, 0]], dtype=np.uint8)
    found = xpt.ibm_to_double(raw)
    assert list(found[:4]) == [1.0, -1.5, 100.0, 0.0] and np.isnan(found[4]) and found[5] == 0x2E / 16
    special = np.array([[ord(c)] + [0] * 7 for c in "._AZ"], dtype=np.uint8)
    assert np.isnan(xpt.ibm_to_double(special)).all()


def test_transport_files(spark, tmp_path):
    import pandas as pd

    rows = [(float(i), None if i % 7 == 0 else i / 8, -float(i)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "SEQN DOUBLE, A DOUBLE, B DOUBLE").repartition(3)
    folder = str(tmp_path / "xpt")
    assert samples.write_xpt(df, folder, rows_per_file=200) >= 3
    whole = xpt.read_xpt(spark, folder, rows_per_partition=100)
    assert whole.rdd.getNumPartitions() >= 10
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))
    with pytest.warns(UserWarning, match="NOPE"):
        part = xpt.read_xpt(spark, folder, ["B", "NOPE", "SEQN"])
    assert part.columns == ["SEQN", "B"]
    assert part.agg(F.sum("B")).first()[0] == -500500.0
    assert xpt.read_xpt(spark, "file://" + folder).count() == 1000
    file = sorted((tmp_path / "xpt").iterdir())[0]
    other = pd.read_sas(file, format="xport")  # an independent reader
    mine = xpt.read_xpt(spark, str(file)).toPandas()
    assert list(other.columns) == list(mine.columns) and len(other) == len(mine)
    assert ((other == mine) | (other.isna() & mine.isna())).all().all()


def transport_file(variables, body):
    """Bytes of a file with (kind, length, name) of each variable."""
    import struct

    described, place = b"", 0
    for kind, length, name in variables:
        entry = struct.pack(">hhhh", kind, 0, length, 1) + name.ljust(8) + b" " * 68 + struct.pack(">i", place)
        described, place = described + entry.ljust(140, b" "), place + length
    head = b" " * 80 * 7 + (xpt.NAMESTR_MARK + b"!!!!!!!" + f"{len(variables):010d}".encode()).ljust(80)
    described, body = (x.ljust(-(-len(x) // 80) * 80) for x in (described, body))
    return head + described + xpt.OBS_MARK.ljust(80) + body


def test_transport_file_with_texts_short_numbers_and_padding(spark, tmp_path):
    body = bytes([0x41, 0x10, 0, 0]) + b"ab " + bytes([0x2E, 0, 0, 0]) + b"   "
    file = tmp_path / "mixed.xpt"
    file.write_bytes(transport_file([(1, 4, b"SEQN"), (2, 3, b"CODE")], body))
    rows = xpt.read_xpt(spark, str(file)).collect()
    assert [tuple(r) for r in rows] == [(1.0, "ab"), (None, "")]


def test_workers_need_no_installed_package():
    from pyspark import cloudpickle

    assert "cohortspan" in cloudpickle.list_registry_pickle_by_value()


def test_transport_file_of_another_kind(tmp_path):
    import io

    with pytest.raises(ValueError, match="not a version 5"):
        xpt.read_layout("x.xpt", io.BytesIO(b"no such thing" * 100), 1300)


def test_rows_with_a_null_key_stay_apart(spark):
    kind = "UserID INT, SEQN INT, BirthDate DATE, Sex STRING, RaceEthnicity STRING"
    stored = spark.createDataFrame([(1, 10, None, "M", "a"), (2, None, None, "F", "b")], kind)
    arriving = spark.createDataFrame(
        [(None, None, "M", "x"), (None, None, "M", "x"), (None, None, "F", "y"), (10, None, "F", "z"), (11, None, "F", "w")],
        "SEQN INT, BirthDate DATE, Sex STRING, RaceEthnicity STRING",
    )
    merged = upsert.upsert_users(stored, arriving).collect()
    assert sorted((r["UserID"] or 0, r["SEQN"] or 0, r["RaceEthnicity"]) for r in merged) == [
        (0, 0, "x"),
        (0, 0, "x"),
        (0, 0, "y"),
        (0, 11, "w"),
        (1, 10, "z"),
        (2, 0, "b"),
    ]
    added = etl.insert_ignore(stored.drop("UserID"), arriving, ["SEQN"], [F.col("Sex")]).collect()
    assert sorted((r["SEQN"] or 0) for r in added) == [0, 0, 0, 11]


def test_loads_say_what_they_leave_out(spark):
    users = spark.createDataFrame([(1, 10), (2, 20)], "UserID INT, SEQN INT")
    sessions = spark.createDataFrame([(5, 1, "2018-01-01")], "SessionID INT, UserID INT, d STRING").selectExpr(
        "SessionID", "UserID", "CAST(d AS DATE) AS SessionDate"
    )
    rows = [(10, "2018-01-01", 1, "4.5"), (10, "2018-01-01", 2, "123456789012"), (20, "2018-01-01", 1, "4"), (99, "2018-01-01", 1, "4")]
    staged = spark.createDataFrame(rows, "SEQN INT, d STRING, BiomarkerID INT, Value STRING").selectExpr(
        "SEQN", "CAST(d AS DATE) AS SessionDate", "BiomarkerID", "Value", "CAST(d AS DATE) AS TakenAt"
    )
    none = spark.createDataFrame([], "SessionID INT, BiomarkerID INT")
    loaded = etl.load_measurements(staged, users, sessions, none).collect()
    rejected = etl.rejected_measurements(staged, users, sessions).collect()
    assert [(r["SessionID"], r["BiomarkerID"]) for r in loaded] == [(5, 1)]
    assert sorted((r["SEQN"], r["BiomarkerID"], r["Reason"]) for r in rejected) == [
        (10, 2, "value_does_not_fit"),
        (20, 1, "no_such_visit"),
        (99, 1, "unknown_participant"),
    ]
    assert len(loaded) + len(rejected) == len(rows)
    body = spark.createDataFrame([(10, 180.0, 80.0, 24.0), (20, 18000.0, 80.0, 24.0), (99, 1.0, 1.0, 1.0)], "SEQN INT, HeightCM DOUBLE, WeightKG DOUBLE, BMI DOUBLE")
    assert sorted((r["SEQN"], r["Reason"]) for r in etl.rejected_anthropometry(body, users).collect()) == [
        (20, "measure_does_not_fit"),
        (99, "unknown_participant"),
    ]


def test_new_users_get_the_next_ids(spark):
    kind = "SEQN INT, BirthDate DATE, Sex STRING, RaceEthnicity STRING"
    stored = spark.createDataFrame([(7, 10, None, "M", "a")], f"UserID INT, {kind}")
    staged = spark.createDataFrame([(30, None, "M", "x"), (10, None, "F", "y"), (20, None, "F", "z"), (20, None, "F", "z")], kind)
    assert sorted((r["UserID"], r["SEQN"]) for r in etl.load_users(staged, stored).collect()) == [(8, 20), (9, 30)]
    nameless = staged.limit(1).withColumn("SEQN", F.lit(None).cast("int"))
    found = etl.load_users(staged.unionByName(nameless).unionByName(nameless), stored).collect()
    assert sorted((r["UserID"], r["SEQN"] or 0) for r in found) == [(8, 0), (9, 0), (10, 20), (11, 30)]


def test_participants_who_are_absent_from_a_file(spark):
    users = spark.createDataFrame([(1,), (2,)], "SEQN INT")
    demo = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "SEQN DOUBLE, RIDEXMON DOUBLE")
    fasting = spark.createDataFrame([(1.0, 9.0, 0.0)], "SEQN DOUBLE, PHAFSTHR DOUBLE, PHAFSTMN DOUBLE")
    visits = etl.clean_sessions(users, demo, fasting).collect()
    assert sorted((r["SEQN"], r["FastingStatus"]) for r in visits) == [(1, 1), (2, 0)]


def test_two_age_bands_of_one_range(spark):
    from conftest import make_tables
    from cohortspan.operators import quality

    t = make_tables(spark, sessions=[(1, 1, day("2024-01-01"), True)], measurements=[(1, 1, "4.5", moment("2024-01-01 00:00:00"))])
    bands = [(1, "clinical", "All", 18, 40, "4", "5"), (1, "clinical", "All", 41, 99, "5", "6")]
    columns = "BiomarkerID INT, RangeType STRING, Sex STRING, AgeMin INT, AgeMax INT, MinVal STRING, MaxVal STRING"
    ranges = spark.createDataFrame(bands, columns).selectExpr(
        "BiomarkerID", "RangeType", "Sex", "AgeMin", "AgeMax", "CAST(MinVal AS DECIMAL(12,4)) AS MinVal", "CAST(MaxVal AS DECIMAL(12,4)) AS MaxVal"
    )
    usage = quality.range_usage(t.replace(ranges=ranges)).collect()
    assert sorted((r["AgeMin"], r["MeasurementCount"], r["InsideCount"]) for r in usage) == [(18, 1, 1), (41, 1, 0)]


def test_transport_files_with_different_columns(spark, tmp_path):
    folder = tmp_path / "x"
    samples.write_xpt(spark.createDataFrame([(1.0, 2.0)], "SEQN DOUBLE, A DOUBLE"), str(folder / "a"))
    samples.write_xpt(spark.createDataFrame([(2.0, 3.0, 4.0)], "SEQN DOUBLE, A DOUBLE, B DOUBLE"), str(folder / "b"))
    rows = xpt.read_xpt(spark, str(folder)).orderBy("SEQN").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, None), (2.0, 3.0, 4.0)]
    assert xpt.read_xpt(spark, str(folder), ["B"]).where("B = 4").count() == 1
    # The same from files that a task cannot open itself.
    whole = xpt.read_xpt(spark, str(folder), in_parts=False).orderBy("SEQN")
    assert whole.collect() == rows and whole.columns == ["SEQN", "A", "B"]

    (folder / "c").mkdir()
    (folder / "c" / "text.XPT").write_bytes(transport_file([(2, 8, b"A")], b"x".ljust(8)))
    with pytest.raises(ValueError, match="text.XPT: A is a number in one file"):
        xpt.read_xpt(spark, str(folder))


def test_transport_files_without_rows_and_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no .xpt file"):
        xpt.read_xpt(spark, str(tmp_path / "none"))
    file = tmp_path / "some.file"  # one file may have any name
    file.write_bytes(transport_file([(1, 8, b"SEQN")], b""))
    empty = xpt.read_xpt(spark, str(file))
    assert empty.columns == ["SEQN"] and empty.count() == 0


def test_many_transport_files_are_planned_by_tasks(spark, tmp_path, monkeypatch):
    one = transport_file([(1, 8, b"SEQN")], bytes([0x41, 0x10, 0, 0, 0, 0, 0, 0]) * 3)
    for n in range(400):
        (tmp_path / f"{n:03d}.xpt").write_bytes(one)
    # Whatever the driver opens itself fails; tasks get their own copy of the code, as it is then.
    layouts = xpt.read_layouts(spark, str(tmp_path))
    monkeypatch.setattr(xpt, "resolve", None)
    assert layouts.count() == 400 and layouts.agg(F.sum("rows")).first()[0] == 1200
    assert xpt.columns_of(layouts) == {"SEQN": True}
    monkeypatch.undo()
    rows = xpt.read_xpt(spark, str(tmp_path), rows_per_partition=2)
    assert rows.agg(F.count("SEQN"), F.sum("SEQN")).first() == (1200, 1200.0)


def test_addresses_of_transport_files():
    assert xpt.resolve("file:///a/b.xpt")[1] == xpt.resolve("file:/a/b.xpt")[1] == xpt.resolve("/a/b.xpt")[1] == "/a/b.xpt"
    assert [xpt.scheme(p) for p in ("/a:b/c", "s3a://bucket/a", "file:/a", "a/b")] == ["", "s3a", "file", ""]
    assert xpt.scheme("oss://bucket/a") not in xpt.IN_PARTS


def test_rejected_lines_come_back_byte_for_byte(spark, tmp_path):
    good = ["1,2024-01-05,1", '"2","2024-01-06","0"', "3,,", " 4 ,2024-01-07,1", '"5",2024-01-08,""']
    bad = [
        '"5","not,a,date","1"', '"6","20""24","1"', "7,2024-02-30,1", "8,2024-01-01", "9,2024-01-01,1,extra", "ten,2024-01-01,1",
        '"11"," 2024,01 ",yes', 'é,"ü, ß",1',
    ]
    for k, lines in enumerate((good[:2] + bad[:4], bad[4:] + good[2:])):
        (tmp_path / f"{k}.csv").write_text("\n".join(['"SEQN","SessionDate","FastingStatus"', *lines]) + "\n", encoding="utf-8")
    rows, rejected = csvfiles.read_csv(spark, str(tmp_path), csvfiles.SESSIONS_CSV)
    assert sorted(r["Line"] for r in rejected.collect()) == sorted(bad)
    assert rejected.count() == len(bad) and rows.select("SEQN").count() == len(good) and rows.count() == len(good)
    found = {r["SEQN"]: (r["SessionDate"], r["FastingStatus"]) for r in rows.collect()}
    assert found[2] == (day("2024-01-06"), 0) and found[3] == (None, None) and found[5] == (day("2024-01-08"), None)
    assert sorted(r["Line"] for r in csvfiles.read_lines(spark, str(tmp_path)).collect()) == sorted(good + bad)
