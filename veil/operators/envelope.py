"""Sealed rows whose data keys travel wrapped for their reader; a new reader's key needs no row sealed again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.crypto import decrypt, encrypt, unwrap_key, wrap_key
from veil.session import small

OPEN = "owner string, key_id string, data_key string"
WRAPPED = "owner string, key_id string, wrapped string"
MOST = 100_000  # keys that are broadcast


def new_keys(spark: SparkSession, owners: list[str], public_key: bytes) -> tuple[DataFrame, DataFrame]:
    """A random data key for each owner named: the open keys (never to be stored) and the wrapped ones, which are stored.

    ``public_key`` is an RSA key in X.509 form. Owners named twice get one key.
    """
    keys = [(o, uuid.uuid4().hex, os.urandom(32)) for o in dict.fromkeys(owners)]
    opened = spark.createDataFrame([(o, k, d.hex()) for o, k, d in keys], OPEN)
    return opened, spark.createDataFrame([(o, k, wrap_key(spark, d, public_key)) for o, k, d in keys], WRAPPED)


def open_keys(wrapped: DataFrame, private_key: bytes) -> DataFrame:
    """The data keys, opened in the driver with an RSA key in PKCS #8 form; ``wrapped`` has one row for each key, not for each value."""
    spark = wrapped.sparkSession
    rows = wrapped.select("owner", "key_id", "wrapped").toLocalIterator()
    return spark.createDataFrame([(r.owner, r.key_id, unwrap_key(spark, r.wrapped, private_key).hex()) for r in rows], OPEN)


def rotate_keys(wrapped: DataFrame, old_private: bytes, new_public: bytes) -> DataFrame:
    """The same keys wrapped for another reader. Rows name their key by id, so none is sealed again."""
    spark = wrapped.sparkSession
    rows = wrapped.select("owner", "key_id", "wrapped").toLocalIterator()
    again = [(r.owner, r.key_id, wrap_key(spark, unwrap_key(spark, r.wrapped, old_private), new_public)) for r in rows]
    return spark.createDataFrame(again, WRAPPED)


def seal_rows(rows: DataFrame, opened: DataFrame, column: str, owner: str = "tenant") -> DataFrame:
    """``column`` sealed under its owner's key, with ``key_id``. Where an owner has no key both are null: nothing stays in clear."""
    keys = small(opened.select(F.col("owner").alias("_owner"), F.col("key_id"), F.col("data_key").alias("_key")), MOST)
    joined = rows.drop("key_id").join(keys, F.col(owner) == F.col("_owner"), "left")
    return joined.withColumn(column, F.when(F.col("_key").isNotNull(), encrypt(F.col(column), F.col("_key")))).drop("_owner", "_key")


def open_rows(rows: DataFrame, opened: DataFrame, column: str) -> DataFrame:
    """``column`` opened by the key that each row names; empty where it can't be."""
    keys = small(opened.select("key_id", F.col("data_key").alias("_key")), MOST)
    return rows.join(keys, "key_id", "left").withColumn(column, decrypt(F.col(column), F.col("_key"))).drop("_key")
