"""A survey cycle in one call: from its transport files to the rows that the tables gain.

The order is that of the references: participants, visits, values, body measures. Each step looks its keys up in what
is stored and what the steps before it add, and passes over what is stored already, so loading a cycle again
adds nothing. Files are cleaned once and stored, since loading and listing what was rejected both read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.operators import etl
from cohortspan.session import cut_lineage
from cohortspan.sources.xpt import read_xpt
from cohortspan.tables import Tables

# The variables of each file that loading looks at; of other files nothing is read.
FILES = {
    "raw_demo": ["RIDAGEYR", "RIAGENDR", "RIDRETH3", "RIDEXMON"],
    "raw_bmx": ["BMXHT", "BMXWT", "BMXBMI"],
    "raw_fastqx": ["PHAFSTHR", "PHAFSTMN"],
    "raw_biopro": ["LBXSAL", "LBXSAPSI", "LBXSCR"],
    "raw_glu": ["LBXGLU"],
    "raw_hscrp": ["LBXHSCRP"],
    "raw_cbc": ["LBXWBCSI", "LBXLYPCT", "LBXMCVSI", "LBXRDW"],
}


@dataclass(frozen=True)
class Loaded:
    added: Tables
    rejected_measurements: DataFrame
    rejected_anthropometry: DataFrame

    def onto(self, t: Tables) -> Tables:
        """The stored tables with the added rows."""
        return t.replace(**{name: getattr(t, name).unionByName(df) for name, df in self.added.items()})


def read_survey(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The files of a cycle, each a transport file or a folder of them, with the columns that loading needs."""
    return {name: read_xpt(spark, path, FILES[name]) for name, path in paths.items()}


def _behind(stored: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with ids that follow the highest stored one, written once."""
    highest = stored.agg(F.max(key)).first()[0] or 0
    found = etl.assign_ids(new, key, order, highest + 1)
    return cut_lineage(found.withColumn(key, F.col(key).cast(stored.schema[key].dataType)).select(*stored.columns), key)


def load_survey(raw: dict[str, DataFrame], t: Tables) -> Loaded:
    """What the tables gain from the raw files of a cycle, and what could not be placed, with reasons.

    All seven files are due. Users, visits and body measures of ``t`` are read for their keys only; values
    are matched by visit and biomarker.
    """
    clean = {name: cut_lineage(df, f"clean-{name}") for name, df in etl.survey_etl(raw, t.biomarkers).items()}
    new_users = cut_lineage(etl.load_users(clean["users"], t.users).select(*t.users.columns), "new-users")
    users = t.users.unionByName(new_users)

    visits = etl.load_sessions(clean["sessions"], users, t.sessions)
    new_sessions = _behind(t.sessions, visits, "SessionID", ["UserID", "SessionDate"])
    sessions = t.sessions.unionByName(new_sessions)

    added = Tables(
        users=new_users,
        sessions=new_sessions,
        measurements=etl.load_measurements(clean["measurements"], users, sessions, t.measurements),
        anthropometry=etl.load_anthropometry(clean["anthropometry"], users, t.anthropometry),
    )
    return Loaded(
        added,
        etl.rejected_measurements(clean["measurements"], users, sessions),
        etl.rejected_anthropometry(clean["anthropometry"], users),
    )
