"""Reading tables and spreading small inputs over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan of fewer files than the session has cores; larger scans stay as they are. Only file names are read.

    Given keys, rows are placed by them, so a later grouping by text finds them in place.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str) -> None:
    """Temporary views of all tables of a folder."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
