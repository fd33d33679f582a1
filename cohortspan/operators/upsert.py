"""Insert-or-update by natural key, and deletes that follow references.

Every function returns the new content of a table. Callers write it to a new place and switch over;
nothing overwrites a path it is reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.etl import split_by_key
from cohortspan.operators.views import first_per_group
from cohortspan.tables import Tables


class Restricted(ValueError):
    """Rows elsewhere still refer to what was to be deleted."""


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    latest_first: Sequence[Column] = (),
) -> DataFrame:
    """``existing`` with the ``update`` columns of matching rows replaced and new keys added.

    ``incoming`` is brought to one row per key first: the first in ``latest_first``, by default the one
    with the highest other columns. So the full outer join meets each key at most once on either side
    and no key can be hot; both steps use the same partitioning. An incoming NULL replaces a stored
    value. Columns that ``incoming`` lacks are NULL in added rows. Rows with a NULL in their key equal no
    other row: stored ones stay and incoming ones are added, as a unique key has it.
    """
    keys = list(keys)
    order = list(latest_first) or [F.col(c).desc() for c in incoming.columns if c not in keys]
    incoming, open_keys = split_by_key(incoming, keys)
    incoming = first_per_group(incoming, keys, order or [F.lit(1)])
    extra = [c for c in incoming.columns if c not in keys]
    renamed = incoming.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in extra], F.lit(True).alias("__in"))
    stored = existing.withColumn("__stored", F.lit(True))
    joined = stored.join(renamed, keys, "full_outer")
    arrived, old = F.col("__in").isNotNull(), F.col("__stored").isNotNull()

    def content(column: str) -> Column:
        kind = existing.schema[column].dataType
        if column in keys:
            return F.col(column)
        if column not in extra:
            return F.col(column)
        fresh = F.col(f"__new_{column}").cast(kind)
        if column in update:
            return F.when(arrived, fresh).otherwise(F.col(column)).alias(column)
        return F.when(old, F.col(column)).otherwise(fresh).alias(column)

    merged = joined.select(*[content(c) for c in existing.columns])
    if open_keys is None:
        return merged
    added = [
        (F.col(c) if c in open_keys.columns else F.lit(None)).cast(existing.schema[c].dataType).alias(c)
        for c in existing.columns
    ]
    return merged.unionByName(open_keys.select(*added))


def upsert_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """By participant number; new users come back without a UserID, for ``assign_ids``."""
    return upsert(users, incoming, ["SEQN"], ["BirthDate", "Sex", "RaceEthnicity"])


def user_ids(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Look up UserID by participant number; unknown participants fall out."""
    return incoming.join(users.select("SEQN", "UserID"), "SEQN").drop("SEQN")


def visit_ids(incoming: DataFrame, users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Look up SessionID by participant number and date; rows without a visit fall out."""
    visits = sessions.select("UserID", "SessionDate", "SessionID")
    return user_ids(incoming, users).join(visits, ["UserID", "SessionDate"]).drop("UserID", "SessionDate")


def upsert_sessions(sessions: DataFrame, incoming: DataFrame, users: DataFrame) -> DataFrame:
    """By user and date; new visits come back without a SessionID."""
    keyed = user_ids(incoming, users)
    return upsert(sessions, keyed, ["UserID", "SessionDate"], ["FastingStatus"])


def upsert_anthropometry(anthropometry: DataFrame, incoming: DataFrame, users: DataFrame) -> DataFrame:
    keyed = user_ids(incoming, users)
    return upsert(anthropometry, keyed, ["UserID", "ExamDate"], ["HeightCM", "WeightKG", "BMI"])


def upsert_measurements(
    measurements: DataFrame, incoming: DataFrame, users: DataFrame, sessions: DataFrame
) -> DataFrame:
    """By visit and biomarker; the visit is looked up by participant number and date.

    Only the value of a stored row changes, its time stays.
    """
    return upsert(measurements, visit_ids(incoming, users, sessions), ["SessionID", "BiomarkerID"], ["Value"])


def upsert_results(results: DataFrame, incoming: DataFrame, users: DataFrame) -> DataFrame:
    keyed = user_ids(incoming, users)
    return upsert(results, keyed, ["UserID", "ModelID", "ComputedAt"], ["BioAgeYears"])


def purge_users(t: Tables, users: DataFrame) -> Tables:
    """Delete users with everything that belongs to them: visits, values, body measures, results."""
    gone = users.select("UserID").distinct()
    gone_sessions = t.sessions.join(gone, "UserID", "left_semi").select("SessionID")
    return t.replace(
        users=t.users.join(gone, "UserID", "left_anti"),
        sessions=t.sessions.join(gone, "UserID", "left_anti"),
        measurements=t.measurements.join(gone_sessions, "SessionID", "left_anti"),
        anthropometry=t.anthropometry.join(gone, "UserID", "left_anti"),
        results=t.results.join(gone, "UserID", "left_anti"),
    )


def _delete_restricted(parent: DataFrame, key: str, ids: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    doomed = ids.select(key).distinct()
    for name, child in children.items():
        if not child.join(doomed, key, "left_semi").isEmpty():
            raise Restricted(f"{name} refers to a row to be deleted")
    return parent.join(doomed, key, "left_anti")


def delete_biomarkers(t: Tables, ids: DataFrame) -> Tables:
    """Delete biomarkers nothing refers to; otherwise raise ``Restricted``."""
    children = {"measurements": t.measurements, "ranges": t.ranges, "coefficients": t.coefficients}
    return t.replace(biomarkers=_delete_restricted(t.biomarkers, "BiomarkerID", ids, children))


def delete_models(t: Tables, ids: DataFrame) -> Tables:
    """Delete models without results; their coefficients go with them."""
    kept = _delete_restricted(t.models, "ModelID", ids, {"results": t.results})
    return t.replace(models=kept, coefficients=t.coefficients.join(ids.select("ModelID"), "ModelID", "left_anti"))


def sample_subset(t: Tables, created: DataFrame | None = None, size: int = 10) -> Tables:
    """The newest ``size`` users with their visits and values, by the time they were stored or by ``created`` (UserID,
    CreatedAt).

    Equal times are settled by the higher user id; users without a time come last.
    """
    known = t.users if created is None else created
    newest = known.orderBy(F.col("CreatedAt").desc(), F.col("UserID").desc()).limit(size).select("UserID")
    sessions = t.sessions.join(newest, "UserID", "left_semi")
    return t.replace(
        users=t.users.join(newest, "UserID", "left_semi"),
        sessions=sessions,
        measurements=t.measurements.join(sessions.select("SessionID"), "SessionID", "left_semi"),
    )
