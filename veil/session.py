"""Session settings the jobs in this package rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a few regexes run per row, so smaller scan splits keep every core busy
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veil")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    Checkpoints hold what ``df`` holds, values in clear included; ``cleanCheckpoints`` in the settings above has Spark delete
    them once nothing refers to them.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it names none, a local session (tests, laptops) gets a
    scratch folder; on a cluster executors could not read that, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veil-")
    return folder.rstrip("/")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a side for broadcast if it has at most so many rows; otherwise leave the join to the optimizer.

    Looks at ``rows + 1`` rows at most, so the check stays cheap however large the side is.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


LIGHT = 32 << 20  # bytes


def light(df: DataFrame, most: int = LIGHT) -> DataFrame:
    """Mark a side for broadcast if its rows, written as text, take at most so many bytes; otherwise leave the join to the optimizer.

    Reads all of ``df``, so it is for sides that are materialized or as cheap.
    """
    taken = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (taken or 0) <= most else df
