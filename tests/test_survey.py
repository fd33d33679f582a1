"""A survey cycle loaded in one call."""

from conftest import SMALL
from pyspark.sql import functions as F

from cohortspan.operators import survey
from cohortspan.sources.samples import write_xpt
from cohortspan.sources.star import derive, survey_tables

LOADED = ["users", "sessions", "measurements", "anthropometry"]


def test_a_cycle_is_loaded_once(spark, tmp_path):
    t = survey_tables(spark, SMALL)
    empty = t.replace(**{name: getattr(t, name).limit(0) for name in LOADED})
    paths = {name: str(tmp_path / name) for name in survey.FILES}
    for name, path in paths.items():
        write_xpt(derive(spark, SMALL, name).where("SEQN < 100060"), path)
    raw = survey.read_survey(spark, paths)
    assert raw["raw_bmx"].columns == ["SEQN", "BMXHT", "BMXWT", "BMXBMI"]

    done = survey.load_survey(raw, empty)
    after = done.onto(empty)
    counts = {name: getattr(after, name).count() for name in LOADED}
    # Code 5 names no group.
    people = derive(spark, SMALL, "raw_demo").where("SEQN < 100060 AND RIAGENDR IS NOT NULL AND RIDRETH3 <> 5").count()
    assert counts["users"] == counts["sessions"] == counts["anthropometry"] == people
    assert after.users.agg(F.min("UserID"), F.max("UserID")).first() == (1, people)
    # Every value of a known participant is placed, every other one is listed.
    values = sum(
        raw[name].select([F.count(c) for c in survey.FILES[name]]).first()[n]
        for name in ("raw_biopro", "raw_glu", "raw_hscrp", "raw_cbc")
        for n in range(len(survey.FILES[name]))
    )
    rejected = done.rejected_measurements
    assert counts["measurements"] + rejected.count() == values
    assert {r["Reason"] for r in rejected.select("Reason").distinct().collect()} <= {"unknown_participant"}
    visits = after.sessions.select("SessionID")
    assert after.measurements.join(visits, "SessionID", "left_anti").count() == 0

    again = survey.load_survey(raw, after)
    assert [getattr(again.added, name).count() for name in LOADED] == [0, 0, 0, 0]
    assert again.onto(after).users.count() == people
