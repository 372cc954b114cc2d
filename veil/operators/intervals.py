"""Span-against-span tests within one text, as running maxima instead of range joins.

Each function takes findings and reference intervals in one DataFrame, tells them apart by a flag,
and needs one grouping by text. Work is linear in the spans of a text, however many overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys):
    return Window.partitionBy(*keys).orderBy("start_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _onward(keys):
    return Window.partitionBy(*keys).orderBy("start_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)


def reach(keys: list[str], is_ref: Column) -> Column:
    """Largest end among the reference spans that start no later than this one."""
    return F.coalesce(F.max(F.when(is_ref, F.col("end_at"))).over(_upto(keys)), F.lit(-1))


def contained(keys: list[str], is_ref: Column) -> Column:
    """Whether some reference span covers this one entirely."""
    return reach(keys, is_ref) >= F.col("end_at")


def overlapping(keys: list[str], is_ref: Column) -> Column:
    """Whether some reference span shares a character with this one."""
    ahead = F.min(F.when(is_ref, F.col("start_at"))).over(_onward(keys))
    return (reach(keys, is_ref) > F.col("start_at")) | F.coalesce(ahead < F.col("end_at"), F.lit(False))


def mark_contained(spans: DataFrame, refs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``spans`` plus a boolean ``flag``: covered by one of ``refs`` (keys, start_at, end_at)."""
    both = spans.withColumn("_ref", F.lit(False)).unionByName(
        refs.select(*keys, "start_at", "end_at").withColumn("_ref", F.lit(True)), allowMissingColumns=True
    )
    return both.withColumn(flag, contained(keys, F.col("_ref"))).where("not _ref").drop("_ref")
