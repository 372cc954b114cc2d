"""Connected components of a table of edges, and groups of sorted rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (v, label): the smallest vertex of each vertex's component.

    Each round every vertex hooks to its smallest neighbour, the trees are flattened by pointer doubling, and the
    edges that are left between trees go on. Each step is an equi-join or a pre-aggregated grouping; the driver sees
    only counts. Vertices without an edge to another are not in the result.
    """
    edges = edges.where("a <> b").select("a", "b")
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct()
    while not edges.isEmpty():
        parent = materialize(edges.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        while True:
            up = parent.select(F.col("a").alias("u"), F.col("p").alias("pp"))
            higher = materialize(parent.join(up, F.col("p") == F.col("u")).select("a", "p", "pp"))
            done = higher.where("p <> pp").isEmpty()
            parent = higher.select("a", F.col("pp").alias("p"))
            if done:
                break
        labels = materialize(labels.join(parent, F.col("label") == F.col("a"), "left").select("v", F.coalesce("p", "label").alias("label")))
        left, right = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = materialize(edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels


def blocks(members: DataFrame, keys: list[str], count: str, by: str, size: int) -> DataFrame:
    """Members of large groups in pairs of blocks: columns lo, hi (the unit's blocks) and side (the member's own).

    A group of n members has about n / size blocks by a hash of ``by``; a member goes to the units of its block with
    each block. Every pair of members meets in one unit, or, if they share a block, in the unit of that block alone.
    """
    n = F.ceil(F.col(count) / F.lit(size)).cast("int")
    return (
        members.withColumn("side", F.pmod(F.xxhash64(by, F.lit(7)), n).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold whole groups of rows sorted by ``keys`` (integers), with the groups' borders."""

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            held.append(batch.slice(a, rows))
            n += held[-1].num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                first = borders(table)
                if len(first) > 2:
                    yield table.slice(0, int(first[-2])).combine_chunks(), first[:-1]
                held = table.slice(int(first[-2])).to_batches()
                n = sum(b.num_rows for b in held)
    if n:
        table = pa.Table.from_batches(held)
        yield table.combine_chunks(), borders(table)


def pairs(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each group ``first[i]`` to ``first[i + 1]``, some at a time."""
    stop = np.repeat(first[1:], np.diff(first))
    left = np.arange(len(stop))
    step = 1
    while True:
        left = left[left + step < stop[left]]
        if not len(left):
            return
        yield left, left + step
        step += 1


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
