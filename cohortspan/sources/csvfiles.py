"""CSV tables: typed loading with rejected rows kept apart, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.schemas import RANGE

CORRUPT = "_corrupt_record"
_CORRUPT_FIELD = T.StructField(CORRUPT, T.StringType())

# Layouts of the cleaned files, as the load step expects them.
USERS_CSV = T.StructType(
    [
        T.StructField("SEQN", T.IntegerType()),
        T.StructField("BirthDate", T.DateType()),
        T.StructField("Sex", T.StringType()),
        T.StructField("RaceEthnicity", T.StringType()),
    ]
)
SESSIONS_CSV = T.StructType(
    [
        T.StructField("SEQN", T.IntegerType()),
        T.StructField("SessionDate", T.DateType()),
        T.StructField("FastingStatus", T.IntegerType()),
    ]
)
MEASUREMENTS_CSV = T.StructType(
    [
        T.StructField("SEQN", T.IntegerType()),
        T.StructField("SessionDate", T.DateType()),
        T.StructField("BiomarkerID", T.IntegerType()),
        T.StructField("Value", T.DecimalType(12, 4)),
        T.StructField("TakenAt", T.DateType()),
    ]
)
ANTHROPOMETRY_CSV = T.StructType(
    [
        T.StructField("SEQN", T.IntegerType()),
        T.StructField("ExamDate", T.DateType()),
        T.StructField("HeightCM", T.DecimalType(5, 2)),
        T.StructField("WeightKG", T.DecimalType(5, 2)),
        T.StructField("BMI", T.DecimalType(4, 2)),
    ]
)
# Comment lines for people who open such a file; readers pass over them.
RANGES_HEADER = (
    "# Normal values of the biomarkers in their catalog units",
    "# One row per biomarker, kind of range, sex and age band",
    "# Columns: biomarker, kind, sex, lowest age, highest age, lowest value, highest value",
)


# A date format that no text has: with it, every line is a record that the reader hands on unread, as it stands.
_NEVER = "'no such date' yyyy"


def read_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The lines of CSV files as they stand in them (``Line``), without each file's first one if that has the names.

    Empty lines are passed over, as CSV readers do.
    """
    unread = T.StructType([T.StructField("unread", T.DateType()), _CORRUPT_FIELD])
    lines = (
        spark.read.schema(unread)
        .option("header", header)
        .option("quote", '"')
        .option("mode", "PERMISSIVE")
        .option("dateFormat", _NEVER)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path)
    )
    # A line of one empty field is no record that fails; it has no other text.
    return lines.select(F.coalesce(CORRUPT, F.col("unread").cast("string"), F.lit('""')).alias("Line"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines of those that do not, byte for byte. Empty fields are NULL.

    Lines are kept while their fields are taken out, first as text and then in their types: so what a line holds does
    not depend on the columns a query asks for, and a rejected one comes back with its quotes.
    """
    names = schema.fieldNames()
    as_text = ", ".join([*[f"`{name}` STRING" for name in names], f"`{CORRUPT}` STRING"])
    options = {"quote": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = read_lines(spark, path, header).withColumn("f", F.from_csv("Line", as_text, options))
    fits = F.col(f"f.{CORRUPT}").isNull()
    for field in schema.fields:
        text = F.col(f"f.`{field.name}`")
        fits &= text.isNull() | (F.trim(text) == "") | text.try_cast(field.dataType).isNotNull()
    good = lines.where(fits).select(*[F.col(f"f.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return good, lines.where(~fits).select("Line")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Reference ranges from a file without column names that opens with comment lines."""
    return spark.read.schema(RANGE).option("header", False).option("comment", "#").csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("quote", '"').csv(path)


def write_ranges(ranges: DataFrame, path: str) -> None:
    """Reference ranges without column names, and the comment lines that explain them.

    Readers pass over comment lines wherever they are, so the order of files does not matter.
    """
    columns = [F.col(name).cast("string") for name in RANGE.fieldNames()]
    lines = ranges.select(F.concat_ws(",", *columns).alias("value"))
    comments = ranges.sparkSession.createDataFrame([(text,) for text in RANGES_HEADER], "value STRING")
    comments.unionByName(lines).write.mode("overwrite").text(path)


def replace_ranges(incoming: DataFrame, folder: str) -> DataFrame:
    """Clear the stored reference ranges and load others in their place."""
    incoming.select(*[F.col(f.name).cast(f.dataType) for f in RANGE.fields]).write.mode("overwrite").parquet(folder)
    return incoming.sparkSession.read.schema(RANGE).parquet(folder)
