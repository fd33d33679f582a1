"""Registering a query together with the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.schemas import CREATED, NATURAL_KEYS, RECORD_IDS, SCHEMAS
from cohortspan.sources.star import BASE, FOUNDED, STATEMENTS, STORED_AT, sql_prefix

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The day all registered queries look back from.
AS_OF = "2001-12-31"

# Pieces that several later pieces read, to be computed once.
MATERIALIZED: set[str] = set()

# Shared pieces of the checking SQL: name -> (what it needs, statement).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    # Rows with the time they were stored and, where the natural key is not one, an id.
    **{
        f"{name}_records": (
            (name,),
            "SELECT "
            + (
                f"row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in NATURAL_KEYS[name])}) AS {RECORD_IDS[name]}, "
                if name in RECORD_IDS
                else ""
            )
            + f"*, {STORED_AT.get(name, FOUNDED)} AS {CREATED} FROM {name}",
        )
        for name in SCHEMAS
    },
    "aged": (("users",), f"SELECT *, CAST(date_sub('year', BirthDate, DATE '{AS_OF}') AS INT) AS Age FROM users"),
    "latest": (
        ("measurements", "sessions", "biomarkers"),
        """SELECT UserID, BiomarkerID, Value, TakenAt, Name AS BiomarkerName, Units FROM (
    SELECT visit.UserID, taken.*, dense_rank() OVER (PARTITION BY visit.UserID, taken.BiomarkerID
      ORDER BY taken.TakenAt DESC) AS age_rank
    FROM measurements taken, sessions visit WHERE visit.SessionID = taken.SessionID) ranked
  NATURAL JOIN (SELECT BiomarkerID, Name, Units FROM biomarkers) named WHERE age_rank = 1""",
    ),
    # Ages 20 to 30, body mass index from 18.5 to below 30.
    "candidates": (
        ("users", "anthropometry"),
        """WITH young AS (SELECT UserID, SEQN, Sex, CAST(2001 - year(BirthDate) AS INT) AS Age FROM users
    WHERE 2001 - year(BirthDate) BETWEEN 20 AND 30),
  healthy AS (SELECT UserID, BMI, HeightCM, WeightKG, ExamDate FROM anthropometry WHERE BMI >= 18.5 AND BMI < 30)
  SELECT UserID, SEQN, Sex, BMI, HeightCM, WeightKG, ExamDate, Age FROM young JOIN healthy USING (UserID)""",
    ),
    "counted": (
        ("measurements",),
        "SELECT BiomarkerID, COUNT(*) AS MeasurementCount FROM measurements GROUP BY BiomarkerID",
    ),
    "terms": (
        ("latest", "coefficients"),
        """SELECT l.UserID, l.BiomarkerID, CAST(c.Coefficient AS DOUBLE)
    * CASE WHEN c.Transform = 'log' THEN CASE WHEN l.x > 0 THEN ln(l.x) END ELSE l.x END AS Term
  FROM (SELECT UserID, BiomarkerID, CASE WHEN BiomarkerID = 4 THEN CAST(Value AS DOUBLE) / CAST(18 AS DOUBLE)
    ELSE CAST(Value AS DOUBLE) END AS x FROM latest) l
  JOIN coefficients c ON c.BiomarkerID = l.BiomarkerID AND c.ModelID = 1""",
    ),
    "linear": (
        ("terms",),
        "SELECT UserID, COUNT(*) AS BiomarkerCount, "
        + " + ".join(f"MAX(CASE WHEN BiomarkerID = {i} THEN Term END)" for i in range(1, 10))
        + " AS LinearTerm FROM terms GROUP BY UserID",
    ),
    "pheno": (
        ("aged", "linear"),
        """SELECT UserID, Age, BioAgeYears, round(BioAgeYears - Age, 2) AS AgeGap, CASE WHEN NOT Complete
    THEN 'insufficient_biomarkers' WHEN BioAgeYears IS NULL THEN 'invalid_value' ELSE 'ok' END AS Status
  FROM (SELECT UserID, Age, Complete, CASE WHEN Complete AND Risk > 0
      THEN round(CAST(141.5 AS DOUBLE) + ln(-ln(1 - Risk)) / CAST(0.09165 AS DOUBLE), 2) END AS BioAgeYears
    FROM (SELECT UserID, Age, Complete, CASE WHEN Raw > 0.999999 THEN CAST(0.999999 AS DOUBLE) ELSE Raw END AS Risk
      FROM (SELECT a.UserID, a.Age, coalesce(n.BiomarkerCount, 0) = 9 AS Complete, 1 - exp(-exp(n.LinearTerm
          + a.Age * CAST(0.0804 AS DOUBLE) + CAST(-19.9067 AS DOUBLE))) AS Raw
        FROM aged a LEFT JOIN linear n ON a.UserID = n.UserID) m) r) p""",
    ),
}


def _closure(names: Sequence[str]) -> tuple[list[str], list[str]]:
    base: list[str] = []
    parts: list[str] = []

    def visit(name: str) -> None:
        if name in PARTS:
            for need in PARTS[name][0]:
                visit(need)
            if name not in parts:
                parts.append(name)
        elif name not in base:
            base.append(name)

    for name in names:
        visit(name)
    return base, parts


def oracle(needs: Sequence[str], body: str) -> str:
    """Statement with all tables and pieces it needs defined in front of it.

    ``body`` is a SELECT, or further definitions that start with a comma and end in a SELECT.
    """
    base, parts = _closure(needs)
    unknown = [name for name in base if name not in (*BASE, *STATEMENTS)]
    if unknown:
        raise KeyError(f"undefined tables {unknown}")
    prefix = sql_prefix(*base)
    defined = "".join(
        f",\n{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({PARTS[name][1]})" for name in parts
    )
    return f"{prefix}{defined}\n{body}"


def query(name: str, needs: Sequence[str] = (), sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: register a function of (spark, folder) under ``name``, with its checking SQL if any."""

    def wrap(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(needs, sql)
        return function

    return wrap


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Doubles cut to comparable digits; engines differ in the last bit."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r(expression: str, digits: int = 6) -> str:
    """The same in SQL; adding zero turns a negative zero into zero."""
    return f"round({expression}, {digits}) + CAST(0 AS DOUBLE)"
