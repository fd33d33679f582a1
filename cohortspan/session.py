"""Session settings, shared scratch folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# What the operators rely on; everything else stays at the cluster's own values.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where the plan above then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_MIB = 1024 * 1024


def sized_settings(shuffled_bytes: int, target_bytes: int = 128 * _MIB) -> dict[str, str]:
    """Settings for a job whose largest shuffle moves about ``shuffled_bytes``.

    Shuffles start with enough partitions for each to fit a task's memory; AQE merges what turns out
    small. They can be set on a running session.
    """
    partitions = max(200, -(-shuffled_bytes // target_bytes))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.files.maxPartitionBytes": str(2 * target_bytes),
    }


# Folders made for local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def build_session(app: str = "cohortspan", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder on this machine.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="cohortspan-")
    return _local_folders[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/cohortspan/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Store the rows in the shared folder and go on from there.

    A written table survives lost executors as a checkpoint does; being columnar it also lets later
    steps read only the columns they use, and tells the optimizer its true size.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
