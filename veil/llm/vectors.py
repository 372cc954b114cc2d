"""Embedding near-dedup: all pairs of vectors whose cosine is 0.95 or more, found by random hyperplanes.

1. Equal vectors are one class, so copies are never compared. Each class gets one bit for each hyperplane.
2. ``tables`` chooses the bits of a table and the number of tables: a pair at the threshold agrees in all bits of some table with
   the target recall. More vectors take more bits, so buckets of unrelated vectors stay small.
3. Ids and bits (not vectors) are shuffled to the buckets, where pairs are compared by all their bits; the bound is one that a pair at
   the threshold misses once in a hundred million times. A pair is looked at in the first table it agrees in, and nowhere else.
4. Only members of such pairs send their vectors to their bucket, where the exact cosine decides. Tasks give back each
   vector's number of links and the smallest member it is connected to, never pairs; components join these.

Large buckets are worked through as pairs of blocks (``graph.blocks``), so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import graph
from veil.llm.tables import parts
from veil.session import materialize, small

THRESHOLD, RECALL = 0.95, 0.9999
#: Members of a block, and what sending a vector's bits to a bucket costs, in comparisons of bits.
BLOCK, SEND = 1024, 256
#: Buckets of more than a block are looked up in a broadcast table up to this many; each has over a thousand rows.
HOT_BUCKETS = 100_000


def agreement(threshold: float) -> float:
    """Chance that a random hyperplane has both vectors of a pair at the threshold on one side."""
    return 1 - math.acos(threshold) / math.pi


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): the cheapest of those that reach the recall for n vectors, by rows sent and unrelated pairs compared."""
    same = agreement(threshold)

    def count(bits: int) -> int:
        return math.ceil(math.log(1 - recall) / math.log1p(-(same**bits)))

    bits = min(range(4, 25), key=lambda b: count(b) * (1 + n / 2**b / SEND))
    return count(bits), bits


def _planes(dims: int, n: int) -> np.ndarray:
    return np.random.default_rng([dims, n]).standard_normal((dims, n))


def _stack(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors of one length as rows of doubles, of length 1."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(n_planes: int):
    """One bit for each hyperplane, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                if dims not in made:
                    made.clear()
                    made[dims] = _planes(dims, n_planes)
                for a in range(0, rows.num_rows, 1024):
                    some = rows.slice(a, 1024)
                    bits = np.packbits(_stack(some.column("vec"), dims) @ made[dims] > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in some.schema.names), pa.array([b.tobytes() for b in bits], pa.binary())], [*some.schema.names, "sig"])

    return run


def _bits(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of n bits."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=n)


def _keys(bits: np.ndarray, n_tables: int) -> np.ndarray:
    """Each row's key in each table."""
    each = bits.reshape(len(bits), n_tables, -1).astype(np.int64)
    return each @ (1 << np.arange(each.shape[2], dtype=np.int64))


def _banded(n_tables: int, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_bits(batch.column("sig"), n_tables * n_bits), n_tables)
                # vectors of different length never meet
                keys = keys + (np.arange(n_tables) << np.int64(n_bits)) + (batch.column("dims").to_numpy().astype(np.int64)[:, None] << np.int64(n_bits + 12))
                for t in range(n_tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), batch.column("cls"), batch.column("sig")], ["bucket", "cls", "sig"])

    return run


def _units(batches: Iterator[pa.RecordBatch], n_tables: int, n_bits: int, least: float):
    """Of each unit (bucket, pair of blocks) its rows, their borders, and the pairs that are to be compared there."""
    for table, first in graph.whole_groups(batches, ["bucket", "lo", "hi"]):
        bits = _bits(table.column("sig"), n_tables * n_bits)
        sign = bits.astype(np.float32) * 2 - 1
        keys = _keys(bits, n_tables)
        bucket, side = table.column("bucket").to_numpy(), table.column("side").to_numpy()
        lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
        here = (bucket >> n_bits) & 0xFFF
        for s, e in zip(first.tolist(), first[1:].tolist()):
            if e - s < 2:
                continue
            x, y = np.nonzero(np.triu(sign[s:e] @ sign[s:e].T >= (2 * least - 1) * sign.shape[1], 1))
            if lo[s] != hi[s]:
                across = side[s + x] != side[s + y]
                x, y = x[across], y[across]
            mine = []
            for a in range(0, len(x), 1 << 16):  # the first table the two agree in
                same = keys[s + x[a : a + (1 << 16)]] == keys[s + y[a : a + (1 << 16)]]
                mine.append(same.argmax(axis=1) == here[s])
            if mine:
                mine = np.concatenate(mine)
                yield table, s, e, x[mine], y[mine]


def _candidates(n_tables: int, n_bits: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, e, x, y in _units(batches, n_tables, n_bits, least):
            if len(x):
                found = table.slice(s, e - s).take(pa.array(np.unique(np.concatenate([x, y]))))
                yield from found.combine_chunks().to_batches()

    return run


def _verified(n_tables: int, n_bits: int, least: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, e, x, y in _units(batches, n_tables, n_bits, least):
            if not len(x):
                continue
            rows = table.slice(s, e - s).combine_chunks()
            vec = _stack(rows.column("vec").combine_chunks(), rows.column("dims")[0].as_py())
            linked = np.zeros((e - s, e - s), bool)
            linked[x, y] = True
            linked &= vec @ vec.T >= threshold
            linked |= linked.T
            cls, docs = rows.column("cls").to_numpy(), rows.column("docs").to_numpy()
            label = graph.stars(e - s, *np.nonzero(linked))
            some = np.flatnonzero(linked.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(cls[label[some]]), pa.array((linked[some] * docs).sum(axis=1).astype(np.int64))], ["cls", "star", "docs"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other rows whose cosine is at least the threshold), component_id (smallest vec_id reachable by links,
    its own included) and kept (vec_id = component_id) for each row of ``vectors``.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing, nor do vectors of
    different length. Repeated rows are rows of their own, linked with each other. A null id is never the smallest, unless
    a component has no other. Very long vectors take longer, no other way. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    usable = F.coalesce(
        F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False)
    )
    # two hashes of 64 bits stand for the vector where rows are brought back to their class
    keyed = rows.select("vec_id", F.when(usable, F.col("vec")).alias("vec")).withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(7), F.reverse("vec"))})
    whole = keyed.where("vec is not null").groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("docs"), F.first("vec").alias("vec"))
    classes = materialize(whole.withColumns({"cls": F.monotonically_increasing_id(), "dims": F.size("vec")}))
    n_tables, n_bits = tables(classes.count(), threshold, recall)
    n, same = n_tables * n_bits, agreement(threshold)
    least = same - 5.6 * math.sqrt(same * (1 - same) / n)
    kind = classes.schema["vec"].dataType.simpleString()
    signed = materialize(classes.select("cls", "docs", "dims", "vec").mapInArrow(_signs(n), f"cls long, docs long, dims int, vec {kind}, sig binary"))

    banded = signed.select("cls", "dims", "sig").mapInArrow(_banded(n_tables, n_bits), "bucket long, cls long, sig binary")
    hot = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    members = banded.join(small(materialize(hot), HOT_BUCKETS), "bucket", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    unit = ["bucket", "lo", "hi"]
    units = graph.blocks(members, ["bucket"], "members", "cls", BLOCK).select(*unit, "side", "cls", "sig")
    units = units.repartition(parts(vectors), *unit).sortWithinPartitions(*unit)
    found = units.mapInArrow(_candidates(n_tables, n_bits, least), "bucket long, lo int, hi int, side int, cls long, sig binary")
    sent = found.join(signed.select("cls", "docs", "dims", "vec"), "cls").repartition(parts(vectors), *unit).sortWithinPartitions(*unit)
    links = materialize(sent.mapInArrow(_verified(n_tables, n_bits, least, threshold), "cls long, star long, docs long"))

    degree = links.groupBy("cls").agg(F.sum("docs").alias("linked"))
    joined = graph.components(links.select(F.col("cls").alias("a"), F.col("star").alias("b")))
    labelled = classes.select("h", "g", "cls", "docs", "low").join(joined, F.col("cls") == F.col("v"), "left").withColumn("label", F.coalesce("label", "cls"))
    least_id = labelled.where("v is not null").groupBy("label").agg(F.min("low").alias("reached"))
    of_class = labelled.join(least_id, "label", "left").join(degree, "cls", "left").select(
        "h", "g", F.coalesce("reached", "low").alias("component_id"), (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    alone = keyed.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    together = keyed.where("vec is not null").select("vec_id", "h", "g").join(of_class, ["h", "g"]).select("vec_id", "n_links", "component_id")
    return together.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
