"""Reading what the operators need, and only that: a clash with any other column of the input is impossible."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``doc_id`` and ``text`` of any table, under these names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts(df: DataFrame, at_least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the needed ones under names no operator uses, and what gives them their names back."""
    names = {c: c if c in needed else f"_c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one value, so that a checkpoint or a shuffle holds it compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()
