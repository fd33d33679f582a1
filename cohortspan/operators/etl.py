"""From wide survey files to rows of the base tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.functions.ordinals import numbered
from cohortspan.operators.views import first_per_group
from cohortspan.session import cut_lineage

# Survey codes and their labels; code 5 is not in use.
SEX_CODES = {1: "M", 2: "F"}
RACE_CODES = {
    1: "Mexican American",
    2: "Other Hispanic",
    3: "Non-Hispanic White",
    4: "Non-Hispanic Black",
    6: "Non-Hispanic Asian",
    7: "Other Race - Including Multi-Racial",
}
# The exam window code gives only half a year, so a date stands for each window.
EXAM_DATES = {1: "2018-01-15", 2: "2018-07-15"}
DEFAULT_EXAM_DATE = "2018-01-01"
CYCLE_YEAR = 2018
FASTING_HOURS = 8


def recode(code: Column, labels: dict[int, str]) -> Column:
    """Label of a numeric code, NULL for a code without one."""
    return F.coalesce(*[F.when(code == value, F.lit(label)) for value, label in labels.items()])


def clean_users(demo: DataFrame) -> DataFrame:
    """Participants with a known sex, group and age."""
    return demo.select(
        F.col("SEQN").cast("int").alias("SEQN"),
        F.col("RIDAGEYR").cast("int").alias("Age"),
        recode(F.col("RIAGENDR"), SEX_CODES).alias("Sex"),
        recode(F.col("RIDRETH3"), RACE_CODES).alias("RaceEthnicity"),
    ).dropna(subset=["SEQN", "Age", "Sex", "RaceEthnicity"])


def with_birth_date(users: DataFrame) -> DataFrame:
    """Replace the age by a mid-year birth date."""
    birth = F.make_date(F.lit(CYCLE_YEAR) - F.col("Age"), F.lit(7), F.lit(1))
    return users.select("SEQN", birth.alias("BirthDate"), "Sex", "RaceEthnicity")


def with_exam_date(df: DataFrame, demo: DataFrame, name: str) -> DataFrame:
    """Add the date of the exam window, looked up by participant."""
    if "RIDEXMON" not in demo.columns:
        return df.withColumn(name, F.lit(DEFAULT_EXAM_DATE).cast("date"))
    window = demo.select(F.col("SEQN").cast("int").alias("SEQN"), "RIDEXMON")
    date = F.coalesce(recode(F.col("RIDEXMON"), EXAM_DATES), F.lit(DEFAULT_EXAM_DATE)).cast("date")
    return df.join(window, "SEQN", "left").withColumn(name, date).drop("RIDEXMON")


def clean_anthropometry(bmx: DataFrame, demo: DataFrame) -> DataFrame:
    """Body measures per participant; rows without any measure stay."""
    body = bmx.where(F.col("SEQN").isNotNull()).select(
        F.col("SEQN").cast("int").alias("SEQN"),
        F.col("BMXHT").alias("HeightCM"),
        F.col("BMXWT").alias("WeightKG"),
        F.col("BMXBMI").alias("BMI"),
    )
    return with_exam_date(body, demo, "ExamDate").select("SEQN", "ExamDate", "HeightCM", "WeightKG", "BMI")


def fasting_status(fastqx: DataFrame) -> DataFrame:
    """One row per participant: 1 after at least eight hours without food.

    Several rows of one participant are told apart by their times, shortest fast first.
    """

    def part(name: str) -> Column:
        if name not in fastqx.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    hours = part("PHAFSTHR") + part("PHAFSTMN") / 60.0
    timed = fastqx.select(F.col("SEQN").cast("int").alias("SEQN"), hours.alias("Hours"))
    first = first_per_group(timed, ["SEQN"], [F.col("Hours")])
    return first.select("SEQN", F.when(F.col("Hours") >= FASTING_HOURS, 1).otherwise(0).alias("IsFasted"))


def clean_sessions(users: DataFrame, demo: DataFrame, fastqx: DataFrame) -> DataFrame:
    """One visit per cleaned participant."""
    visits = with_exam_date(users.select("SEQN"), demo, "SessionDate")
    status = F.coalesce(F.col("IsFasted"), F.lit(0)).alias("FastingStatus")
    return visits.join(fasting_status(fastqx), "SEQN", "left").select("SEQN", "SessionDate", status)


def melt(df: DataFrame, keys: str | Sequence[str], names: str, values: str) -> DataFrame:
    """Wide to long: one row per key and non-missing column."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, columns, names, values).where(F.col(values).isNotNull())


def clean_measurements(labs: Sequence[DataFrame], demo: DataFrame, biomarkers: DataFrame) -> DataFrame:
    """Long form of all laboratory files, with the biomarker looked up by its variable code."""
    stacked = None
    for lab in labs:
        # The date joins one wide row per participant, not each of its values.
        dated = with_exam_date(lab.withColumn("SEQN", F.col("SEQN").cast("int")), demo, "TakenAt")
        long = melt(dated, ["SEQN", "TakenAt"], "NHANESVarCode", "Value")
        stacked = long if stacked is None else stacked.unionByName(long)
    known = stacked.join(biomarkers.select("NHANESVarCode", "BiomarkerID"), "NHANESVarCode").dropna()
    return known.select("SEQN", F.col("TakenAt").alias("SessionDate"), "BiomarkerID", "Value", "TakenAt")


def split_by_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is complete, and those with a NULL in it; None where no key column can be NULL."""
    nullable = [k for k in keys if df.schema[k].nullable]
    if not nullable:
        return df, None
    return df.dropna(subset=nullable), df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in nullable]))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows a unique key lets in: not stored yet, and first among themselves.

    As in a unique key, rows with a NULL in it are all different.
    """
    complete, open_keys = split_by_key(incoming, keys)
    new = first_per_group(complete, keys, order).join(existing.select(*keys), keys, "left_anti")
    return new if open_keys is None else new.unionByName(open_keys.select(*new.columns))


def by_user(staged: DataFrame, users: DataFrame, buckets: int | None) -> DataFrame:
    """Look up the user id by participant number; with ``buckets``, deal the rows as tables bucketed by user are."""
    keyed = staged.join(users.select("SEQN", "UserID"), "SEQN")
    return keyed if buckets is None else keyed.repartition(buckets, "UserID")


def load_sessions(staged: DataFrame, users: DataFrame, existing: DataFrame, buckets: int | None = None) -> DataFrame:
    """New visits with the user id looked up by participant number.

    ``buckets`` says that ``existing`` is stored in so many buckets of users: it is then read in place.
    """
    fasting = F.col("FastingStatus").cast("boolean").alias("FastingStatus")
    first = first_per_group(staged, ["SEQN", "SessionDate"], [fasting]) if buckets else staged
    keyed = by_user(first, users, buckets).select("UserID", "SessionDate", fasting)
    return insert_ignore(existing, keyed, ["UserID", "SessionDate"], [F.col("FastingStatus")])


def load_measurements(
    staged: DataFrame, users: DataFrame, sessions: DataFrame, existing: DataFrame, buckets: int | None = None
) -> DataFrame:
    """New values with the visit looked up by participant number and date; others fall out.

    A value outside the column's range does not fit and falls out as well; ``rejected_measurements``
    lists what falls out and why.

    ``buckets`` says that ``sessions`` and ``existing`` are stored in so many buckets of users, values with their user.
    Both are then read in place: only the staged rows move, once to their participant and once to their user.
    """
    value, taken = F.col("Value").try_cast("decimal(12,4)").alias("Value"), F.col("TakenAt").cast("timestamp").alias("TakenAt")
    key = ["SessionID", "BiomarkerID"] if buckets is None else ["UserID", "SessionID", "BiomarkerID"]
    keyed = (
        by_user(staged, users, buckets)
        .join(sessions.select("UserID", "SessionDate", "SessionID"), ["UserID", "SessionDate"])
        .select(*key, value, taken)
        .where("Value IS NOT NULL")
    )
    new = insert_ignore(existing, keyed, key, [F.col("TakenAt"), F.col("Value")])
    return new.select("SessionID", "BiomarkerID", "Value", "TakenAt")


def rejected_measurements(staged: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """The staged values that ``load_measurements`` cannot place, each with a reason."""
    known = users.select("SEQN", "UserID", F.lit(True).alias("UserKnown"))
    visits = sessions.select("UserID", "SessionDate", F.lit(True).alias("Visited"))
    reason = (
        F.when(F.col("UserKnown").isNull(), "unknown_participant")
        .when(F.col("Visited").isNull(), "no_such_visit")
        .when(F.col("Value").try_cast("decimal(12,4)").isNull(), "value_does_not_fit")
    )
    found = staged.join(known, "SEQN", "left").join(visits, ["UserID", "SessionDate"], "left")
    return found.withColumn("Reason", reason).where("Reason IS NOT NULL").select(*staged.columns, "Reason")


def rejected_anthropometry(staged: DataFrame, users: DataFrame) -> DataFrame:
    """Staged body measures of unknown participants, and those with a measure that the table cannot hold.

    ``load_anthropometry`` stores the latter with that measure missing.
    """
    known = users.select("SEQN", F.lit(True).alias("UserKnown"))
    too_large = [
        F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
        for name, kind in (("HeightCM", "decimal(5,2)"), ("WeightKG", "decimal(5,2)"), ("BMI", "decimal(4,2)"))
    ]
    reason = F.when(F.col("UserKnown").isNull(), "unknown_participant").when(
        reduce(lambda a, b: a | b, too_large), "measure_does_not_fit"
    )
    found = staged.join(known, "SEQN", "left").withColumn("Reason", reason)
    return found.where("Reason IS NOT NULL").select(*staged.columns, "Reason")


def load_users(staged: DataFrame, users: DataFrame) -> DataFrame:
    """New users with the next free ids, in the order of their participant numbers; known numbers are passed over.

    Users without a number are all new and come first.
    """
    new = insert_ignore(users, staged, ["SEQN"], [F.col(c) for c in staged.columns if c != "SEQN"])
    highest = users.agg(F.max("UserID")).first()[0] or 0
    found = assign_ids(new, "UserID", ["SEQN", *[c for c in staged.columns if c != "SEQN"]], highest + 1)
    return found.select(F.col("UserID").cast(users.schema["UserID"].dataType).alias("UserID"), *staged.columns)


def load_anthropometry(staged: DataFrame | None, users: DataFrame, existing: DataFrame) -> DataFrame:
    """New body measures; without an input file there is nothing to add. Empty fields stay NULL."""
    if staged is None:
        return existing.limit(0)
    keyed = staged.join(users.select("SEQN", "UserID"), "SEQN").select(
        "UserID",
        "ExamDate",
        F.col("HeightCM").try_cast("decimal(5,2)").alias("HeightCM"),
        F.col("WeightKG").try_cast("decimal(5,2)").alias("WeightKG"),
        F.col("BMI").try_cast("decimal(4,2)").alias("BMI"),
    )
    return insert_ignore(
        existing, keyed, ["UserID", "ExamDate"], [F.col("HeightCM"), F.col("WeightKG"), F.col("BMI")]
    )


def assign_ids(df: DataFrame, name: str, order: Sequence[str | Column], start: int = 1) -> DataFrame:
    """Consecutive 64-bit ids from ``start`` in the given order; they depend on the data only, not on how it is partitioned."""
    return numbered(df, name, order, start)


def fill_ids(df: DataFrame, name: str, order: Sequence[str | Column]) -> DataFrame:
    """Give rows without an id the next free ones; the highest id in use is the one value fetched.

    The rows are read for that value and for themselves, so they are stored first.
    """
    df = cut_lineage(df, "merged")
    used = df.agg(F.max(name)).first()[0] or 0
    new = assign_ids(df.where(F.col(name).isNull()).drop(name), name, order, used + 1)
    kind = df.schema[name].dataType
    new = new.withColumn(name, F.col(name).cast(kind)).select(*df.columns)
    return df.where(F.col(name).isNotNull()).unionByName(new)


def survey_etl(raw: dict[str, DataFrame], biomarkers: DataFrame) -> dict[str, DataFrame]:
    """All cleaned tables from the raw files, keyed as the raw files are."""
    users = clean_users(raw["raw_demo"])
    labs = [raw[name] for name in ("raw_biopro", "raw_glu", "raw_hscrp", "raw_cbc")]
    return {
        "users": with_birth_date(users),
        "sessions": clean_sessions(users, raw["raw_demo"], raw["raw_fastqx"]),
        "measurements": clean_measurements(labs, raw["raw_demo"], biomarkers),
        "anthropometry": clean_anthropometry(raw["raw_bmx"], raw["raw_demo"]),
    }
