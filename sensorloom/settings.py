"""Session settings. Everything is read from the live session, never hard-wired."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Largest number of rows one group may bring into one task before the skew-safe
# plan takes over, and the largest number of groups listed as too long.
MAX_GROUP_ROWS = "spark.sensorloom.maxGroupRows"
MAX_DISTINCT = "spark.sensorloom.maxDistinct"
DEFAULT_MAX_GROUP_ROWS = 2_000_000
DEFAULT_MAX_DISTINCT = 1_000_000
MAX_LISTED_GROUPS = 65_536


def build_session(app: str = "sensorloom", master: str | None = None, **options: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution).

    Options are passed as ``spark__sql__shuffle__partitions="400"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def max_distinct(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_DISTINCT, str(DEFAULT_MAX_DISTINCT)))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder the cluster names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, inside the one the cluster names for checkpoints."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/sensorloom-tables"


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names.

    Only a local session without any folder falls back to a temporary one; on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder
