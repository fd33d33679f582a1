"""Health tables derived from the given star schema.

The given data has customers, orders and line items but no laboratory tables, so persons, visits
and values are computed from them with integer arithmetic. The statements use only SQL that
Spark and the checking engine share; a name in braces stands for a table or an earlier statement.

Line items are reduced to one value per order and biomarker before they meet the visits, so an
order with very many lines collapses on the map side. No statement leaves a customer, order or line
out; what a person did not answer or have measured is NULL.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cohortspan import catalog
from cohortspan.schemas import CATALOGS
from cohortspan.tables import NAMES, Tables

BASE = ("customer", "orders", "lineitem")

_SEQN = "CAST(100000+c_custkey AS DOUBLE) AS SEQN"

STATEMENTS = {
    "users": """SELECT CAST(c_custkey+1 AS INT) AS UserID, CAST(100000+c_custkey AS INT) AS SEQN,
  make_date(CAST(CASE WHEN c_custkey%2=0 THEN 1971+(c_custkey*7)%11 ELSE 1931+(c_custkey*7)%70 END AS INT),
    CAST(1+c_custkey%12 AS INT), CAST(1+c_custkey%28 AS INT)) AS BirthDate,
  CASE WHEN c_nationkey%2=0 THEN 'M' ELSE 'F' END AS Sex, c_mktsegment AS RaceEthnicity FROM {customer}""",
    "sessions": """SELECT CAST(MIN(o_orderkey)+1 AS INT) AS SessionID, CAST(o_custkey+1 AS INT) AS UserID,
  CAST(o_orderdate AS DATE) AS SessionDate,
  MIN(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END)=1 AS FastingStatus
  FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    # Every order belongs to the visit of its customer and day, whichever of them named the visit.
    "order_visit": """SELECT CAST(o_orderkey+1 AS INT) AS OrderID, CAST(o_custkey+1 AS INT) AS UserID,
  CAST(MIN(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE))+1 AS INT) AS SessionID,
  CAST(o_orderdate AS DATE) AS SessionDate FROM {orders}""",
    "order_values": """SELECT OrderID, BiomarkerID, CAST(MIN(CASE BiomarkerID WHEN 1 THEN 30000+25*h
    WHEN 2 THEN 300000+1500*h WHEN 3 THEN 4000+12*h WHEN 4 THEN 600000+700*h WHEN 5 THEN 1000+60*h
    WHEN 6 THEN 30000+100*h WHEN 7 THEN 150000+350*h WHEN 8 THEN 780000+250*h ELSE 110000+50*h END)
    * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(12,4)) AS Value
  FROM (SELECT CAST(l_orderkey+1 AS INT) AS OrderID, CAST(l_partkey%9+1 AS INT) AS BiomarkerID,
    (CAST(round(l_extendedprice*100) AS BIGINT)+37*l_orderkey)%1000 AS h FROM {lineitem}) l
  GROUP BY OrderID, BiomarkerID""",
    "measurements": """SELECT s.SessionID, v.BiomarkerID, CAST(MIN(v.Value) AS DECIMAL(12,4)) AS Value,
  CAST(MIN(s.SessionDate) AS TIMESTAMP) AS TakenAt
  FROM {order_values} v JOIN {order_visit} s ON s.OrderID = v.OrderID GROUP BY s.SessionID, v.BiomarkerID""",
    # The same with the user and day of the visit, as stored tables keep them.
    "measured": """SELECT s.SessionID, v.BiomarkerID, CAST(MIN(v.Value) AS DECIMAL(12,4)) AS Value,
  CAST(MIN(s.SessionDate) AS TIMESTAMP) AS TakenAt, MIN(s.UserID) AS UserID, MIN(s.SessionDate) AS SessionDate
  FROM {order_values} v JOIN {order_visit} s ON s.OrderID = v.OrderID GROUP BY s.SessionID, v.BiomarkerID""",
    "anthropometry": """SELECT UserID, MAX(SessionDate) AS ExamDate, CAST(150+UserID%45 AS DECIMAL(5,2)) AS HeightCM,
  CAST(45+UserID%60 AS DECIMAL(5,2)) AS WeightKG, CASE WHEN UserID%50=0 THEN NULL
    ELSE CAST((1600+(UserID*131)%1700)*CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,2)) END AS BMI
  FROM {sessions} GROUP BY UserID""",
    "results": """SELECT UserID, CAST(1+SessionID%2 AS INT) AS ModelID,
  CAST((1800+(CAST(SessionID AS BIGINT)*97)%6500)*CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS BioAgeYears,
  CAST(SessionDate AS TIMESTAMP) AS ComputedAt FROM {sessions}""",
    "biomarkers": catalog.catalog_sql("biomarkers"),
    "models": catalog.catalog_sql("models"),
    "coefficients": catalog.catalog_sql("coefficients"),
    "ranges": catalog.catalog_sql("ranges", "seed"),
    "ranges_etl": catalog.catalog_sql("ranges", "etl"),
    # Raw survey files, one wide row per participant.
    "raw_demo": f"""SELECT {_SEQN}, CAST((c_custkey*7)%81 AS DOUBLE) AS RIDAGEYR,
  CASE WHEN c_custkey%97=0 THEN NULL ELSE CAST(1+c_custkey%2 AS DOUBLE) END AS RIAGENDR,
  CAST(1+c_custkey%7 AS DOUBLE) AS RIDRETH3,
  CASE c_custkey%3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) END AS RIDEXMON FROM {{customer}}""",
    "raw_bmx": f"""SELECT {_SEQN}, CAST(40+c_custkey%60 AS DOUBLE) AS BMXWT, CAST(150+c_custkey%45 AS DOUBLE) AS BMXHT,
  CASE WHEN c_custkey%50=0 THEN NULL ELSE CAST(1600+(c_custkey*131)%1700 AS DOUBLE)/100 END AS BMXBMI FROM {{customer}}""",
    # Not everybody answers the fasting questionnaire: one market segment leaves it empty.
    "raw_fastqx": f"""SELECT {_SEQN}, CASE WHEN c_custkey%13=0 OR c_mktsegment='MACHINERY' THEN NULL
    ELSE CAST(c_custkey%20 AS DOUBLE) END AS PHAFSTHR,
  CASE WHEN c_mktsegment='MACHINERY' THEN NULL ELSE CAST((c_custkey*7)%60 AS DOUBLE) END AS PHAFSTMN FROM {{customer}}""",
    "raw_biopro": f"""SELECT {_SEQN}, CASE WHEN c_custkey%11=0 THEN NULL ELSE CAST(30+(c_custkey*13)%25 AS DOUBLE)/10 END AS LBXSAL,
  CAST(40+(c_custkey*17)%110 AS DOUBLE) AS LBXSAPSI, CAST(50+(c_custkey*19)%100 AS DOUBLE)/100 AS LBXSCR FROM {{customer}}""",
    # Fasting glucose is not measured for everybody: only with a balance above zero.
    "raw_glu": f"""SELECT {_SEQN}, CASE WHEN c_acctbal > 0 THEN CAST(65+(c_custkey*23)%80 AS DOUBLE) END AS LBXGLU
  FROM {{customer}}""",
    "raw_hscrp": f"""SELECT {_SEQN},
  CASE WHEN c_custkey%17=0 THEN NULL ELSE CAST(10+(c_custkey*29)%600 AS DOUBLE)/100 END AS LBXHSCRP FROM {{customer}}""",
    "raw_cbc": f"""SELECT {_SEQN}, CAST(30+(c_custkey*31)%80 AS DOUBLE)/10 AS LBXWBCSI,
  CAST(150+(c_custkey*37)%300 AS DOUBLE)/10 AS LBXLYPCT, CAST(780+(c_custkey*41)%220 AS DOUBLE)/10 AS LBXMCVSI,
  CAST(110+(c_custkey*43)%50 AS DOUBLE)/10 AS LBXRDW FROM {{customer}}""",
    # Incoming visits: every order is one submission, every line one of its values.
    "submission": """SELECT CAST(o_orderkey AS BIGINT) AS SubmissionID,
  CAST(CASE WHEN o_orderkey%101=0 THEN 2000000000 ELSE o_custkey+1 END AS INT) AS UserID,
  CASE WHEN o_orderkey%53=0 THEN 'not-a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS SessionDateText,
  CASE WHEN o_orderkey%71=0 THEN NULL ELSE o_orderkey%2=0 END AS FastingStatus FROM {orders}""",
    "submitted_value": """SELECT CAST(l_orderkey AS BIGINT) AS SubmissionID,
  CAST(CASE WHEN l_partkey%211=0 THEN 77 ELSE l_partkey%9+1 END AS INT) AS BiomarkerID,
  CASE WHEN l_partkey%307=0 THEN NULL ELSE CAST(1+(l_partkey*7)%50 AS DECIMAL(12,4)) END AS Value FROM {lineitem}""",
    # Free-text durations as users type them.
    "range_text": """SELECT CAST(o_orderkey AS BIGINT) AS RequestID, CASE CAST(o_orderkey%9 AS INT)
    WHEN 0 THEN '6months' WHEN 1 THEN concat(CAST(o_custkey%40 AS STRING), ' days')
    WHEN 2 THEN concat('  ', CAST(o_custkey%9 AS STRING), ' WEEK ') WHEN 3 THEN concat(CAST(o_custkey%5 AS STRING), 'Years')
    WHEN 4 THEN 'forever' WHEN 5 THEN concat('-', CAST(o_custkey%7 AS STRING), ' days') WHEN 6 THEN ''
    WHEN 7 THEN concat(CAST(o_custkey%3 AS STRING), ' month s') ELSE concat(CAST(o_custkey%12 AS STRING), ' month') END AS RangeText
  FROM {orders}""",
}

# When the rows were stored, as expressions over them; catalogs and whatever is not named here at ``FOUNDED``.
STORED_AT = {
    "users": "CAST(make_date(CAST(1992+UserID%7 AS INT), CAST(1+UserID%12 AS INT), CAST(1+UserID%28 AS INT)) AS TIMESTAMP)",
    "sessions": "CAST(SessionDate AS TIMESTAMP)",
    "measurements": "TakenAt",
    "anthropometry": "CAST(ExamDate AS TIMESTAMP)",
    "results": "ComputedAt",
}
FOUNDED = "CAST(DATE '1992-01-01' AS TIMESTAMP)"

RAW = ("raw_demo", "raw_bmx", "raw_fastqx", "raw_biopro", "raw_glu", "raw_hscrp", "raw_cbc")


def _needs(name: str) -> list[str]:
    text = STATEMENTS[name]
    return [t for t in (*BASE, *STATEMENTS) if "{" + t + "}" in text]


_seen_schemas: dict[str, StructType] = {}


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A given table; its schema is looked up in the files once, which saves a job per later scan."""
    if path not in _seen_schemas:
        _seen_schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_seen_schemas[path]).parquet(path)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy DataFrame over the parquet files in ``sf_dir``."""
    if name in BASE:
        return _scan(spark, f"{sf_dir}/{name}.parquet")
    inputs = {need: derive(spark, sf_dir, need) for need in _needs(name)}
    return spark.sql(STATEMENTS[name], **inputs)


def survey_tables(spark: SparkSession, sf_dir: str, range_set: str = "seed") -> Tables:
    """The base tables over one set of scans; a table no operator asks for is never made."""
    made: dict[str, DataFrame] = {}

    def make(name: str) -> DataFrame:
        if name not in made:
            if name in BASE:
                made[name] = derive(spark, sf_dir, name)
            elif name in CATALOGS:
                made[name] = catalog.literal(spark, name, range_set)
            else:
                made[name] = spark.sql(STATEMENTS[name], **{need: make(need) for need in _needs(name)})
        return made[name]

    return Tables(measured=partial(make, "measured"), **{name: partial(make, name) for name in NAMES})


def sql_prefix(*names: str) -> str:
    """``WITH`` clause that defines the named tables, and what they need, for the checking engine."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for need in _needs(name):
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    plain = {key: key for key in (*BASE, *STATEMENTS)}
    parts = [
        f"{name} AS ({reduce(lambda s, k: s.replace('{' + k + '}', plain[k]), _needs(name), STATEMENTS[name])})"
        for name in ordered
    ]
    return "WITH " + ",\n".join(parts)
