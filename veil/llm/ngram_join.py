"""N-gram Jaccard join: all pairs of documents whose sets of word 5-grams are alike by 0.8 or more.

1. Each document's set is hashed; documents with equal sets are one class, so copies are never compared.
2. MinHash banding. ``bands`` chooses rows and bands so that a pair at the threshold shares a band with the target recall.
   Band hashes are shuffled; classes that share one, agree in sizes, and whose whole signatures agree well enough (a
   bound that a pair at the threshold misses once in a hundred million times) are joined into candidate groups.
3. Each candidate group is verified: all its pairs, by their full sets, in blocks.

Large buckets and groups are worked through as pairs of blocks (``graph.blocks``), and tasks give back sums and stars,
never pairs: rows stay linear in the classes while each pair is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import graph
from veil.llm import words as W
from veil.llm.tables import hidden, parts
from veil.session import materialize

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members of a block: of a bucket (signatures), of a candidate group (whole sets).
BUCKET_BLOCK, GROUP_BLOCK = 1000, 256


def bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands for the target recall stay within so many hash functions."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 16):
        n = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if n * rows <= hashes:
            best = (n, rows)
    return best


def sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-gram hashes of each text, and their borders. A text of fewer than k words is one gram."""
    hashes, room, owner = w.hashes(), w.room(), w.owner()
    grams = W.runs(hashes, k)
    ok = room >= k
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    whole = W.total_hash(hashes, w.first)[short]
    own, values = np.concatenate([owner[ok], short]), np.concatenate([grams[ok], whole])
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (values[1:] != values[:-1])
    own, values = own[new], values[new]
    return values, np.searchsorted(own, np.arange(len(w.first)))


def _signer(n_hashes: int, k: int):
    factors = np.random.default_rng(20).integers(1, 1 << 63, size=n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "text", W.SLICE_BYTES // 2):
                values, first = sets(W.split(rows.column("text"), W.ALNUM, lower_ascii=True), k)
                full = np.flatnonzero(np.diff(first))
                signature = np.zeros((rows.num_rows, n_hashes), np.uint16)
                if len(full):
                    for j in range(n_hashes):
                        x = values * factors[j]
                        x ^= x >> np.uint64(32)
                        low = np.minimum.reduceat(x, first[full])
                        signature[full, j] = W.mix(low) & np.uint64(0xFFFF)
                flat = signature.tobytes()
                step = 2 * n_hashes
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), rows.column("key"), pa.array(W.total_hash(values, first).view(np.int64)), pa.array(np.diff(first).astype(np.int32)),
                        pa.array([flat[i * step : (i + 1) * step] for i in range(rows.num_rows)], pa.binary()),
                    ],
                    ["doc_id", "key", "cls", "n", "sig"],
                )

    return run


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _band_hashes(n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signature = _signatures(batch.column("sig")).astype(np.uint64)
            for b in range(n_bands):
                h = np.full(batch.num_rows, b, np.uint64)
                for j in range(b * rows, (b + 1) * rows):
                    h = W.mix(h * np.uint64(65537) + signature[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("cls")], ["bucket", "cls"])

    return run


def _candidates(threshold: float, n_hashes: int):
    share = Fraction(str(threshold))
    p, q = share.numerator, share.denominator
    least = threshold - 5.6 * math.sqrt(threshold * (1 - threshold) / n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in graph.whole_groups(batches, ["bucket", "lo", "hi"]):
            signature = _signatures(table.column("sig"))
            n, side = table.column("n").to_numpy().astype(np.int64), table.column("side").to_numpy()
            one_block = (table.column("lo").to_numpy() == table.column("hi").to_numpy())
            a, b = [], []
            for x, y in graph.pairs(first):
                ok = (one_block[x] | (side[x] != side[y])) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                ok = (signature[x] == signature[y]).mean(axis=1) >= least
                a.append(x[ok])
                b.append(y[ok])
            if a:
                label = graph.stars(table.num_rows, np.concatenate(a), np.concatenate(b))
                hit = np.flatnonzero(label != np.arange(len(label)))
                cls = table.column("cls").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(cls[label[hit]])], ["a", "b"])

    return run


def _packed_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "text"):
                values, first = sets(W.split(rows.column("text"), W.ALNUM, lower_ascii=True), k)
                blobs = [values[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("grp", "members", "cls", "docs")] + [pa.array(blobs, pa.binary())], ["grp", "members", "cls", "docs", "grams"])

    return run


def _overlaps(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of some sets and of all their intersections, by products of incidence matrices a few columns at a time."""
    sets_ = [np.frombuffer(x, np.uint64) for x in blobs]
    size = np.array([len(s) for s in sets_])
    row = np.repeat(np.arange(len(sets_)), size)
    _, column, often = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])]) if len(column) else column
    # a product of so few columns is exact in float32, their sum need not be
    both = np.zeros((len(sets_), len(sets_)), np.int64)
    width = 8192
    for c in range(0, int(new[-1]) + 1 if len(new) else 0, width):
        a, b = np.searchsorted(new, [c, c + width])
        m = np.zeros((len(sets_), width), np.float32)
        m[row[a:b], new[a:b] - c] = 1
        both += (m @ m.T).astype(np.int64)
    return size, both


def _verify(threshold: float):
    share = Fraction(str(threshold))
    p, q = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in graph.whole_groups(batches, ["grp", "lo", "hi"], rows=256):
            docs, cls, side = (table.column(c).to_numpy() for c in ("docs", "cls", "side"))
            one_block = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            blobs = table.column("grams").to_pylist()
            for s, e in zip(first.tolist(), first[1:].tolist()):
                size, both = _overlaps(blobs[s:e])
                # |A and B| >= p / q * |A or B|, in integers
                linked = both * (p + q) >= p * (size[:, None] + size[None, :])
                np.fill_diagonal(linked, False)
                if not one_block[s]:
                    linked &= side[s:e, None] != side[None, s:e]
                a, b = np.nonzero(np.triu(linked))
                label = graph.stars(e - s, a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[s:e]), pa.array(cls[s:e][label]), pa.array((linked * docs[s:e]).sum(axis=1).astype(np.int64)), pa.array(linked.sum(axis=1).astype(np.int64))],
                    ["cls", "star", "docs", "texts"],
                )

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text):

    * ``class_id``: smallest doc_id of the documents it is linked with, directly or over others, itself included,
    * ``copy_id``: smallest doc_id of those with an equal set of grams, * ``n_links``: rows it is linked with directly,
    * ``n_copies``: of these, rows with an equal set, * ``key``: hash of the text.

    Texts of fewer than five words are one gram. Null texts and texts without words have no grams: they are a class of
    their own each, without links. A null id is never the smallest, unless a class has no other. Repeated rows are copies.
    """
    n_bands, rows = bands(threshold, recall)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    slim = materialize(keyed.mapInArrow(_signer(n_bands * rows, shingle), "doc_id long, key long, cls long, n int, sig binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    classes = materialize(slim.where("n > 0").groupBy("cls").agg(first, F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    banded = classes.select("cls", "sig").mapInArrow(_band_hashes(n_bands, rows), "bucket long, cls long")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = banded.join(full, "bucket").join(classes.select("cls", "n", "sig"), "cls")
    units = graph.blocks(members, ["bucket"], "members", "cls", BUCKET_BLOCK).select("bucket", "lo", "hi", "side", "cls", "n", "sig")
    units = units.repartition(parts(docs), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    groups = graph.components(units.mapInArrow(_candidates(threshold, n_bands * rows), "a long, b long"))

    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    chosen = groups.join(sizes, "label").join(classes, F.col("v") == F.col("cls")).select(F.col("label").alias("grp"), "members", "cls", "docs", F.col("rep.doc_id").alias("r_id"), F.col("rep.key").alias("r_key"))
    found = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key"))).dropDuplicates(["cls"])
    packed = found.select("grp", "members", "cls", "docs", "text").mapInArrow(_packed_sets(shingle), "grp long, members long, cls long, docs long, grams binary")
    units = graph.blocks(packed, ["grp"], "members", "cls", GROUP_BLOCK).select("grp", "lo", "hi", "side", "cls", "docs", "grams")
    units = units.repartition(parts(docs), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    verified = materialize(units.mapInArrow(_verify(threshold), "cls long, star long, docs long, texts long"))

    links = verified.groupBy("cls").agg(F.sum("docs").alias("linked"))
    linked_groups = graph.components(verified.select(F.col("cls").alias("a"), F.col("star").alias("b")))
    least = classes.select("cls", "docs", "rep").join(linked_groups, F.col("cls") == F.col("v"), "left").withColumn("label", F.coalesce("label", "cls"))
    ids = least.where("label <> cls or v is not null").groupBy("label").agg(F.min("rep").alias("low"))
    of_class = least.join(ids, "label", "left").join(links, "cls", "left").select(
        "cls", "docs", F.col("rep.doc_id").alias("copy_id"), F.coalesce("low.doc_id", "rep.doc_id").alias("class_id"), F.coalesce("low.key", "rep.key").alias("class_key"),
        F.coalesce("linked", F.lit(0)).alias("linked"),
    )
    alone = slim.where("n = 0").select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies")
    )
    return slim.where("n > 0").select("doc_id", "key", "cls").join(of_class, "cls").select(
        "doc_id", "key", "class_id", "class_key", "copy_id", (F.col("docs") - 1 + F.col("linked")).alias("n_links"), (F.col("docs") - 1).alias("n_copies")
    ).unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all its columns, one row for each class of near duplicates: the one of smallest id.

    Documents without words all stay; of rows that repeat an id and a text one stays.
    """
    docs, restore = hidden(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keep = near_duplicates(slim, **options).where("doc_id <=> class_id and key = class_key").select(F.col("doc_id").alias("_keep_id"), F.col("key").alias("_keep_key")).distinct()
    rows = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(F.col(text_col).cast("string"))})
    return restore(rows.join(keep, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_key") == F.col("_keep_key"))).dropDuplicates(["_id", "_key"]))
