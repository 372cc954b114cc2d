"""Where results go. Only masked texts and sealed values are ever written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.crypto import decrypt, encrypt
from veil.operators.audit import EVENT_COLUMNS
from veil.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder for intermediate output, in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_redacted(redacted: DataFrame, like: DataFrame, path: str, text: str = "text", masked: str = "redacted") -> None:
    """Write masked rows in exactly the shape of the rows they came from."""
    shaped = redacted.select(*[F.col(masked).alias(c) if c == text else F.col(c) for c in like.columns])
    want = [(f.name, f.dataType) for f in like.schema.fields]
    if [(f.name, f.dataType) for f in shaped.schema.fields] != want:
        raise ValueError("masking changed the schema")
    shaped.write.mode("overwrite").parquet(path)


def write_token_map(token_map: DataFrame, path: str, key_hex: Column, session: str = "session_id") -> None:
    """Write the token map partitioned by session hash, with values and their normal forms sealed."""
    (
        token_map.withColumn("canonical", encrypt(F.col("canonical"), key_hex))
        .withColumn("norm", encrypt(F.col("norm"), key_hex))
        .withColumn("part", F.pmod(F.xxhash64(session), F.lit(16)).cast("int"))
        .write.mode("overwrite").partitionBy("part").parquet(path)
    )


def read_token_map(spark: SparkSession, path: str, key_hex: Column) -> DataFrame:
    stored = spark.read.parquet(path).drop("part")
    return stored.withColumn("canonical", decrypt(F.col("canonical"), key_hex)).withColumn("norm", decrypt(F.col("norm"), key_hex))


def write_events(events: DataFrame, path: str) -> None:
    """Write audit events; any column beyond the permitted ones is refused."""
    extra = set(events.columns) - set(EVENT_COLUMNS)
    if extra:
        raise ValueError(f"columns not allowed in audit events: {sorted(extra)}")
    events.select(*EVENT_COLUMNS).write.mode("overwrite").parquet(path)
