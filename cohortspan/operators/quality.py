"""Checks of the stored data: counts, keys, references, domains, catalogs and populations.

Each check is one small table, so results can be stored and compared over time. Catalog checks also
say how many measurements hang on a catalog row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.catalog import BIOMARKERS, COEFFICIENTS, MODELS, range_rows, values_sql
from cohortspan.operators.queries import measurement_counts
from cohortspan.operators.views import hd_reference_candidates, latest_measurements
from cohortspan.schemas import DOMAINS, NATURAL_KEYS, REFERENCES, SCHEMAS
from cohortspan.tables import Tables

EXPECTED_ROWS = {
    "biomarkers": len(BIOMARKERS),
    "models": len(MODELS),
    "ranges": len(range_rows()),
    "coefficients": len(COEFFICIENTS),
}
# Fixed value: how far a stored coefficient may be from the published one.
TOLERANCE = 0.000001
# Biomarkers whose clinical ranges must exist.
CLINICALLY_CHECKED = (1, 2, 3, 4, 5, 9)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(t: Tables) -> DataFrame:
    """Rows per table, and whether a catalog has as many as it should."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("RowCount")).select(
            F.lit(name).alias("TableName"),
            "RowCount",
            F.lit(EXPECTED_ROWS.get(name)).cast("int").alias("Expected"),
        )
        for name, df in t.items()
    ]
    return _union(parts).withColumn("Ok", F.col("Expected").isNull() | (F.col("Expected") == F.col("RowCount")))


def unique_keys(checked: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table and key: keys that occur more than once and rows beyond the first."""
    parts = []
    for name, (df, keys) in checked.items():
        complete = df.dropna(subset=keys)
        repeated = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(
            repeated.agg(
                F.count(F.lit(1)).alias("DuplicateKeys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("ExtraRows")
            ).select(
                F.lit(name).alias("TableName"), F.lit(",".join(keys)).alias("KeyColumns"), "DuplicateKeys", "ExtraRows"
            )
        )
    return _union(parts)


def unique_keys_of(t: Tables) -> DataFrame:
    return unique_keys({name: (df, NATURAL_KEYS[name]) for name, df in t.items()})


def foreign_keys(t: Tables) -> DataFrame:
    """Rows per reference whose parent is missing.

    Parents and children meet in one aggregation: every table is read once and says, for each of its columns that takes
    part, in which domain (the parent's column) the value lies and whether it is defined or used there, and by which
    reference. Uses are counted per key before the one shuffle, so a frequent key travels as one row per task. A key
    that is used and nowhere defined is an orphan.
    """
    tables = dict(t.items())
    uses: dict[str, list[Column]] = {name: [] for name in tables}

    def tagged(parent: str, column: str, reference: int) -> Column:
        return F.struct(
            F.lit(parent).alias("Domain"), F.col(column).cast("bigint").alias("Key"), F.lit(reference).alias("Reference")
        )

    for parent, column in sorted({(parent, column) for _, _, column, parent in REFERENCES}):
        uses[parent].append(tagged(parent, column, -1))
    for i, (_, child, column, parent) in enumerate(REFERENCES):
        uses[child].append(tagged(parent, column, i))
    rows = [
        tables[name].select(F.explode(F.array(*tags)).alias("t")).select("t.*").where("Key IS NOT NULL")
        for name, tags in uses.items()
        if tags
    ]
    references = range(len(REFERENCES))
    keys = reduce(DataFrame.unionByName, rows).groupBy("Domain", "Key").agg(
        F.max(F.col("Reference") == -1).alias("Defined"), *[F.count_if(F.col("Reference") == i).alias(f"n{i}") for i in references]
    )
    counts = keys.where("NOT Defined").agg(
        *[F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}") for i in references],
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"r{i}") for i in references],
    )
    cells = [
        F.struct(F.lit(name).alias("ForeignKey"), F.col(f"k{i}").alias("OrphanKeys"), F.col(f"r{i}").alias("OrphanRows"))
        for i, (name, *_) in enumerate(REFERENCES)
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _problems(name: str, schema: T.StructType) -> list[tuple[str, str, Column]]:
    found = []
    for field in schema.fields:
        value = F.col(field.name)
        if not field.nullable:
            found.append((field.name, "null", value.isNull()))
        if isinstance(field.dataType, T.DecimalType):
            limit = 10 ** (field.dataType.precision - field.dataType.scale)
            found.append((field.name, "out_of_range", F.abs(value) >= limit))
        if (name, field.name) in DOMAINS:
            found.append((field.name, "not_in_domain", ~value.isin(DOMAINS[(name, field.name)])))
    return found


def domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per column that are NULL, beyond the decimal range or outside the enumeration.

    All rules of a table are counted in one scan.
    """
    parts = []
    for name, df in tables.items():
        rules = _problems(name, SCHEMAS[name])
        counts = df.agg(
            *[F.coalesce(F.sum(F.when(bad, 1)), F.lit(0)).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)]
        )
        cells = [
            F.struct(F.lit(column).alias("ColumnName"), F.lit(rule).alias("Rule"), F.col(f"r{i}").alias("BadRows"))
            for i, (column, rule, _) in enumerate(rules)
        ]
        parts.append(counts.select(F.lit(name).alias("TableName"), F.explode(F.array(*cells)).alias("c")))
    return _union(parts).select("TableName", "c.*")


def columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """Required columns that are missing or of another type, from the schemas alone."""
    problems = []
    for name, df in tables.items():
        present = {f.name.lower(): f.dataType for f in df.schema.fields}
        for field in SCHEMAS[name].fields:
            kind = present.get(field.name.lower())
            if kind is None:
                problems.append((name, field.name, "missing"))
            elif kind != field.dataType:
                problems.append((name, field.name, f"{kind.simpleString()} instead of {field.dataType.simpleString()}"))
    return problems


def with_measurements(df: DataFrame, t: Tables) -> DataFrame:
    counted = df.join(measurement_counts(t), "BiomarkerID", "left")
    return counted.withColumn("MeasurementCount", F.coalesce(F.col("MeasurementCount"), F.lit(0)))


def coefficients(t: Tables) -> DataFrame:
    """Stored against published coefficients, by name without regard to case."""
    names = {number: name for number, name, *_ in BIOMARKERS}
    published = t.sessions.sparkSession.sql(
        values_sql([(names[b].lower(), c) for _, b, c, _ in COEFFICIENTS], "Key STRING, Expected DOUBLE")
    )
    stored = (
        t.coefficients.join(t.models.where(F.lower("ModelName") == "phenotypic age").select("ModelID"), "ModelID")
        .join(t.biomarkers.select("BiomarkerID", "Name"), "BiomarkerID")
        .select("BiomarkerID", F.trim(F.lower("Name")).alias("Key"), F.col("Coefficient").cast("double").alias("Stored"))
    )
    both = with_measurements(stored.join(published, "Key", "full_outer"), t)
    status = (
        F.when(F.col("Stored").isNull(), "missing")
        .when(F.col("Expected").isNull(), "unexpected")
        .when(F.abs(F.col("Stored") - F.col("Expected")) > TOLERANCE, "different")
        .otherwise("ok")
    )
    return both.select(F.col("Key").alias("Biomarker"), "Stored", "Expected", status.alias("Status"), "MeasurementCount")


def model_completeness(t: Tables) -> DataFrame:
    """Biomarkers and log transforms per model; a model without coefficients counts none."""
    counted = with_measurements(t.coefficients, t)
    return (
        t.models.join(counted, "ModelID", "left")
        .groupBy("ModelID", "ModelName")
        .agg(
            F.count("BiomarkerID").alias("BiomarkerCount"),
            F.count(F.when(F.col("Transform") == "log", 1)).alias("LogTransforms"),
            F.coalesce(F.sum("MeasurementCount"), F.lit(0)).alias("MeasurementCount"),
        )
    )


def range_coverage(t: Tables) -> DataFrame:
    """Ranges per biomarker and type, number of sexes among them, and whether a required one is missing."""
    kind = F.lower("RangeType")
    per_biomarker = t.ranges.groupBy("BiomarkerID").agg(
        F.count(F.when(kind == "clinical", 1)).alias("Clinical"),
        F.count(F.when(kind == "longevity", 1)).alias("Longevity"),
        F.countDistinct("Sex").alias("Sexes"),
    )
    covered = t.biomarkers.select("BiomarkerID", "Name").join(per_biomarker, "BiomarkerID", "left")
    filled = covered.fillna(0, subset=["Clinical", "Longevity", "Sexes"])
    required = F.col("BiomarkerID").isin(*CLINICALLY_CHECKED)
    return with_measurements(filled, t).withColumn("Ok", ~required | (F.col("Clinical") > 0))


def hd_population(t: Tables, as_of: dt.date | str) -> DataFrame:
    """Size and spread of the reference candidates, and of their latest values."""
    candidates = hd_reference_candidates(t, as_of)
    spread = candidates.agg(
        F.count(F.lit(1)).alias("Candidates"),
        F.min("Age").alias("MinAge"),
        F.max("Age").alias("MaxAge"),
        F.min("BMI").alias("MinBMI"),
        F.max("BMI").alias("MaxBMI"),
    )
    people = candidates.groupBy("UserID").agg(F.count(F.lit(1)).alias("rows"))
    values = latest_measurements(t, people).groupBy("UserID").agg(F.count(F.lit(1)).alias("latest"))
    joined = people.join(values, "UserID").agg(
        F.coalesce(F.sum(F.col("rows") * F.col("latest")), F.lit(0)).alias("JoinedRows")
    )
    healthy = (F.col("MinBMI") >= 18.5) & (F.col("MaxBMI") < 30.0)
    return _side_by_side([spread, joined]).withColumn("BmiOk", healthy)


def _side_by_side(one_row_tables: list[DataFrame]) -> DataFrame:
    """Tables of one row as one row: stacked, and folded by the highest value of each column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_tables)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def catalog_order(t: Tables) -> DataFrame:
    """The variable code expected at each position of the catalog beside the one that is there."""
    expected = t.sessions.sparkSession.sql(
        values_sql([(b, code) for b, _, code, *_ in BIOMARKERS], "BiomarkerID INT, ExpectedCode STRING")
    )
    found = t.biomarkers.select("BiomarkerID", F.upper("NHANESVarCode").alias("FoundCode"))
    both = with_measurements(found.join(expected, "BiomarkerID", "full_outer"), t)
    return both.withColumn("Ok", F.col("FoundCode").eqNullSafe(F.col("ExpectedCode")))


def five_table_join(t: Tables, limit: int | None = None) -> DataFrame:
    """Values per biomarker through visit, user and body measurements, by left joins.

    A value counts once per body measurement of its user. Values are counted per user and biomarker
    and body measurements per user before the two meet, so the product is never built.
    """
    body = t.anthropometry.groupBy("UserID").agg(F.count(F.lit(1)).alias("bodies"))
    users = t.users.select("UserID").join(body, "UserID", "left")
    per_user = (
        t.measurements.where("Value IS NOT NULL")
        .select("SessionID", "BiomarkerID")
        .join(t.sessions.select("SessionID", "UserID"), "SessionID", "left")
        .groupBy("UserID", "BiomarkerID")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(users, "UserID", "left")
        .groupBy("BiomarkerID")
        .agg(F.sum(F.col("n") * F.coalesce(F.col("bodies"), F.lit(1))).alias("MeasurementCount"))
    )
    result = t.biomarkers.join(per_user, "BiomarkerID", "left").select(
        "BiomarkerID", "Name", F.coalesce(F.col("MeasurementCount"), F.lit(0)).alias("MeasurementCount")
    )
    return result if limit is None else result.orderBy("BiomarkerID").limit(limit)


def range_usage(t: Tables) -> DataFrame:
    """Measurements of each range's biomarker, and how many of them lie inside.

    The few ranges meet the values first; the partial counts then leave a row per range and task, so no
    value is shuffled where the ranges are broadcast, as built-in ones are.
    """
    keys = ["BiomarkerID", "RangeType", "Sex", "AgeMin", "AgeMax", "MinVal", "MaxVal"]
    inside = (F.col("MinVal") <= F.col("Value")) & (F.col("Value") <= F.col("MaxVal"))
    used = t.measurements.select("BiomarkerID", "Value").join(t.ranges, "BiomarkerID").select(
        *keys, F.lit(1).alias("MeasurementCount"), F.when(inside, 1).otherwise(0).alias("InsideCount")
    )
    unused = t.ranges.select(*keys, F.lit(0).alias("MeasurementCount"), F.lit(0).alias("InsideCount"))
    counts = [F.sum(c).alias(c) for c in ("MeasurementCount", "InsideCount")]
    return used.unionByName(unused).groupBy(*keys).agg(*counts)


def summary(t: Tables, as_of: dt.date | str) -> DataFrame:
    """One row that sums the checks up, ready to be written as JSON."""
    parts = [
        t.biomarkers.agg(F.count(F.lit(1)).alias("biomarkers")),
        t.ranges.agg(
            F.count(F.lit(1)).alias("reference_ranges"),
            F.count(F.when(F.col("RangeType") == "clinical", 1)).alias("clinical_ranges"),
            F.count(F.when(F.col("RangeType") == "longevity", 1)).alias("longevity_ranges"),
        ),
        t.models.join(t.coefficients, "ModelID", "left").agg(
            F.countDistinct("ModelID").alias("models"), F.count("BiomarkerID").alias("coefficients")
        ),
        hd_reference_candidates(t, as_of).agg(F.count(F.lit(1)).alias("hd_reference_candidates")),
        t.users.agg(F.count(F.lit(1)).alias("users")),
        t.measurements.agg(F.count(F.lit(1)).alias("measurements")),
    ]
    return _side_by_side(parts)


def write_summary(t: Tables, as_of: dt.date | str, folder: str) -> None:
    summary(t, as_of).write.mode("overwrite").json(folder)
