"""The nine base tables as one value that operators pass around."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.schemas import MEASURED, RECORDS, SCHEMAS

NAMES = tuple(SCHEMAS)


class Tables:
    """Base tables by name, each a DataFrame or a function that makes it when it is first used."""

    users: DataFrame
    sessions: DataFrame
    biomarkers: DataFrame
    measurements: DataFrame
    anthropometry: DataFrame
    ranges: DataFrame
    models: DataFrame
    coefficients: DataFrame
    results: DataFrame

    def __init__(self, *, measured: Callable[[], DataFrame] | None = None, **sources: DataFrame | Callable[[], DataFrame]):
        unknown = set(sources) - set(NAMES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self._sources = sources
        self._measured = measured

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        if name not in self._sources:
            raise ValueError(f"table {name} was not given")
        source = self._sources[name]
        df = source if isinstance(source, DataFrame) else source()
        setattr(self, name, df)
        return df

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in NAMES if name in self._sources]

    def names(self) -> list[str]:
        return [name for name in NAMES if name in self._sources]

    def measured(self) -> DataFrame:
        """Measurements of known visits with their UserID and SessionDate.

        Stored tables keep both beside every value, so that a question about few users reads few of the
        measurements; else the visits are joined.
        """
        if self._measured is not None:
            return self._measured()
        visits = self.sessions.select("SessionID", "UserID", "SessionDate")
        return self.measurements.join(visits, "SessionID")

    def replace(self, **changed: DataFrame | Callable[[], DataFrame]) -> Tables:
        measured = None if {"measurements", "sessions"} & set(changed) else self._measured
        return Tables(measured=measured, **{**self._sources, **changed})

    def register(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        for name, df in self.items():
            df.createOrReplaceTempView(prefix + name)


# How fact tables are laid out: by key, and within a key by what tells its rows apart, so that the
# rows of one frequent key can end up in several files.
LAYOUT = {
    "sessions": ["UserID", "SessionDate"],
    "measurements": ["UserID", "BiomarkerID", "TakenAt"],
    "anthropometry": ["UserID", "ExamDate"],
    "results": ["UserID", "ComputedAt"],
}


def write_tables(tables: Tables, folder: str) -> None:
    """Write each table as parquet in the declared types.

    Facts are range-partitioned and sorted by user: the statistics in the files then let a question about
    few users skip most of them. Measurements get the user and day of their visit for it; those without a
    visit keep their place with neither. Ids of rows and the time they were stored are kept where a table has them.
    """
    given = dict(tables.items())
    for name, df in given.items():
        fields = SCHEMAS[name].fields
        if name == "measurements":
            fields = MEASURED.fields
            visits = given["sessions"].select("SessionID", "UserID", "SessionDate") if "sessions" in given else None
            none = {"UserID": F.lit(None), "SessionDate": F.lit(None)}
            df = df.withColumns(none) if visits is None else df.join(visits, "SessionID", "left")
        own = {f.name for f in fields}
        fields = [*fields, *(f for f in RECORDS[name].fields if f.name not in own and f.name in df.columns)]
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        if name in LAYOUT:
            typed = typed.repartitionByRange(*LAYOUT[name]).sortWithinPartitions(*LAYOUT[name])
        typed.write.mode("overwrite").parquet(f"{folder}/{name}")


def scan_tables(spark: SparkSession, folder: str, records: bool = False) -> Tables:
    """Read the base tables with their declared schemas; no inference job runs.

    Stored catalogs carry no hint: Spark decides by their size in bytes how to join them. ``records`` adds ids of rows
    and the times they were stored, NULL where they were not written.
    """
    schemas = RECORDS if records else SCHEMAS

    def read(name: str) -> DataFrame:
        return spark.read.schema(schemas[name]).parquet(f"{folder}/{name}")

    def measured() -> DataFrame:
        return spark.read.schema(MEASURED).parquet(f"{folder}/measurements").where("UserID IS NOT NULL")

    return Tables(measured=measured, **{name: partial(read, name) for name in NAMES})


# Tables that are looked up together by user, as stored: values with the user and day of their visit.
COLOCATED = {"users": SCHEMAS["users"], "sessions": SCHEMAS["sessions"], "measurements": MEASURED}
CLUSTER_KEY = "UserID"


def _colocated_name(prefix: str, name: str) -> str:
    return f"{prefix}_{name}"


def write_colocated(tables: Tables, folder: str, prefix: str, buckets: int) -> Tables:
    """Write users, visits and values bucketed alike by user, as tables ``prefix_name`` of the session's catalog.

    Joins between them, and windows and joins on more columns beside the user, then need no exchange. The rows of one
    user share a bucket; their number is bounded by days and biomarkers, since these are keys.
    """
    given = dict(tables.items())
    for name, schema in COLOCATED.items():
        if name not in given:
            continue
        df = given[name]
        if name == "measurements" and CLUSTER_KEY not in df.columns:
            df = df.join(given["sessions"].select("SessionID", "UserID", "SessionDate"), "SessionID", "left")
        typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        # The exchange deals rows to tasks as bucketing deals them to files, so each task writes one file.
        (
            typed.repartition(buckets, CLUSTER_KEY)
            .write.mode("overwrite")
            .bucketBy(buckets, CLUSTER_KEY)
            .sortBy(CLUSTER_KEY)
            .option("path", f"{folder}/{name}")
            .saveAsTable(_colocated_name(prefix, name))
        )
    spark = next(iter(given.values())).sparkSession
    return scan_colocated(spark, prefix, [name for name in COLOCATED if name in given])


def register_colocated(spark: SparkSession, folder: str, prefix: str, buckets: int) -> Tables:
    """Make tables that another session wrote with ``write_colocated`` known to this one."""
    for name, schema in COLOCATED.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {_colocated_name(prefix, name)} ({columns}) USING parquet CLUSTERED BY ({CLUSTER_KEY}) "
            f"SORTED BY ({CLUSTER_KEY}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
        )
    return scan_colocated(spark, prefix, list(COLOCATED))


def scan_colocated(spark: SparkSession, prefix: str, names: list[str]) -> Tables:
    # A join on user and day may rely on a partitioning by user alone.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return Tables(**{name: spark.table(_colocated_name(prefix, name)) for name in names})


def bucket_count(spark: SparkSession, prefix: str) -> int:
    """Number of buckets of tables written by ``write_colocated``, as the catalog has it."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {_colocated_name(prefix, 'users')}")
    return int(described.where("col_name = 'Num Buckets'").first()["data_type"])
