"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window), a window into shingles
of ``SHINGLE`` words. A document holds a window only if it holds all its shingles, so with all shingles ordered by
rarity in the corpus the prefix that must be joined is one shingle: the window's rarest. Where a document has it,
the shingle's place in the window says where the window would begin; that place and the window's length must lie
within the document, and the words there are compared one by one with the item's.

The corpus is read twice (counting the benchmark's shingles, then joining), without moving a text: blocks of
``BLOCK`` windows go to the tasks. A larger benchmark is worked through block by block, each block marking what
the earlier ones have left, with a written table between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import words as W
from veil.session import materialize

WINDOW, SHINGLE = 13, 5
#: Windows sent to all tasks at once: under 500 bytes each.
BLOCK = 100_000
_MASK = np.uint64((1 << 20) - 1)


def windows(bench: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: ``words`` (joined by one space), ``n`` words, ``items`` (ids that have it)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.slices(batch, "text"):
                w = W.split(rows.column("text"), W.ALNUM, lower_ascii=True)
                item = rows.column("item").to_pylist()
                out = []
                for i, (a, b) in enumerate(zip(w.first, w.first[1:])):
                    for s in range(a, max(b - window, a) + 1) if b > a else ():
                        e = min(s + window, b)
                        out.append((item[i], w.text(s, e).decode(), e - s))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32()))], ["item", "words", "n"])

    slim = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return slim.mapInArrow(cut, "item string, words string, n int").groupBy("words", "n").agg(F.collect_set("item").alias("items"))


class Block:
    """A block of windows as arrays: words' hashes, shingles, and after ``choose`` the shingle to join on."""

    def __init__(self, rows, shingle: int):
        self.words = [r["words"].encode() for r in rows]
        self.items = [sorted(i for i in r["items"] if i is not None) + [i for i in r["items"] if i is None] for r in rows]
        self.n = np.array([r["n"] for r in rows], np.int64)
        split = W.split(pa.array([r["words"] for r in rows], pa.large_string()), W.ALNUM)
        self.k = np.minimum(self.n, shingle)
        hashes = split.hashes()
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(self.k).tolist():
            grams = W.runs(hashes, k)
            of = [np.arange(a, b - k + 1) for a, b, kk in zip(split.first, split.first[1:], self.k) if kk == k]
            which = np.repeat(np.flatnonzero(self.k == k), [len(x) for x in of])
            at = np.concatenate(of)
            self.shingles[k] = (which, at - split.first[which], grams[at])

    def lookups(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each shingle length: its distinct hashes, sorted, and a bit table of their low bits."""
        out = {}
        for k, (_, _, grams) in self.shingles.items():
            seen = np.zeros(1 << 20, bool)
            seen[grams & _MASK] = True
            out[k] = (np.unique(grams), seen)
        return out

    def choose(self, counts: dict[tuple[int, int], int]) -> Chosen:
        """The rarest shingle of each window; a window with a shingle that no document has is dropped: it can't occur."""
        return Chosen(self, counts)


class Chosen:
    def __init__(self, block: Block, counts: dict[tuple[int, int], int]):
        self.words, self.items, self.n = block.words, block.items, block.n
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (which, offset, grams) in block.shingles.items():
            df = np.array([counts.get((k, g), 0) for g in grams.view(np.int64).tolist()], np.int64)
            order = np.lexsort((offset, grams, df, which))
            first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
            first = first[df[first] > 0]
            first = first[np.argsort(grams[first], kind="stable")]
            seen = np.zeros(1 << 20, bool)
            seen[grams[first] & _MASK] = True
            self.prefix[k] = (grams[first], which[first], offset[first], seen)


def _places(sorted_hashes: np.ndarray, seen: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of ``grams`` whose hash is among ``sorted_hashes``."""
    at = np.flatnonzero(seen[grams & _MASK])
    if not len(at) or not len(sorted_hashes):
        return at[:0]
    found = np.searchsorted(sorted_hashes, grams[at])
    return at[sorted_hashes[np.minimum(found, len(sorted_hashes) - 1)] == grams[at]]


def _counter(lookups):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookups.value
        for batch in batches:
            for rows in W.slices(batch, "text"):
                w = W.split(rows.column("text"), W.ALNUM, lower_ascii=True)
                hashes, room, owner = w.hashes(), w.room(), w.owner()
                for k, (known, seen) in table.items():
                    grams = W.runs(hashes, k)
                    at = _places(known, seen, grams)
                    at = at[room[at] >= k]
                    # documents, not places: each shingle once for a document
                    pairs = np.unique(np.stack([owner[at].astype(np.uint64), grams[at]]), axis=1)[1]
                    values, n = np.unique(pairs, return_counts=True)
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])

    return count


def _marker(chosen):
    """Adds to each row's ``hits`` (places of hit words, as 32-bit numbers) and ``items`` what this block's windows hit."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = chosen.value
        for batch in batches:
            for rows in W.slices(batch, "text"):
                w = W.split(rows.column("text"), W.ALNUM, lower_ascii=True)
                hashes, room, owner = w.hashes(), w.room(), w.owner()
                covered: dict[int, list] = {}
                items: dict[int, set] = {}
                for k, (known, which, offset, seen) in block.prefix.items():
                    grams = W.runs(hashes, k)
                    at = _places(known, seen, grams)
                    at = at[room[at] >= k]
                    lo, hi = np.searchsorted(known, grams[at]), np.searchsorted(known, grams[at], side="right")
                    place = np.repeat(at, hi - lo)
                    entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)]) if len(at) else np.zeros(0, np.int64)
                    begin, window = place - offset[entry], which[entry]
                    doc = owner[place]
                    ok = begin >= w.first[doc]
                    begin, window, doc = begin[ok], window[ok], doc[ok]
                    ok = begin + block.n[window] <= w.first[doc + 1]
                    for s, x, d in zip(begin[ok].tolist(), window[ok].tolist(), doc[ok].tolist()):
                        n = int(block.n[x])
                        if w.text(s, s + n) == block.words[x]:
                            covered.setdefault(d, []).append(np.arange(s, s + n) - w.first[d])
                            items.setdefault(d, set()).update(block.items[x])
                before_hits, before_items = rows.column("hits").to_pylist(), rows.column("items").to_pylist()
                hits = [np.unique(np.concatenate([np.frombuffer(h or b"", np.int32), *covered[i]])).astype(np.int32).tobytes() if i in covered else h for i, h in enumerate(before_hits)]
                found = [sorted({*(x or ()), *items[i]}, key=lambda s: (s is None, s or "")) if i in items else x for i, x in enumerate(before_items)]
                keep = [c for c in rows.schema.names if c not in ("n_words", "hits", "items")]
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in keep], pa.array(w.counts.astype(np.int64)), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))],
                    [*keep, "n_words", "hits", "items"],
                )

    return mark


def mark(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_hit`` (words inside a window's occurrence) and ``items`` (ids with a
    window in the text, sorted as strings).

    One row for each input row, whatever its id. Null and empty texts have no words and no hits; items without words
    have no windows; an empty benchmark hits nothing. A null item id counts as an item. Columns of ``docs`` named
    n_words, hits, items or n_hit are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "hits", "items")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema], "n_words long, hits binary, items array<string>"])
    state = docs.select(*own, F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = windows(bench, window, item_id, item_text).withColumn("place", F.xxhash64("words"))
    blocks = materialize(blocks)
    n_blocks = max(1, -(-blocks.count() // (block // 2 or 1)))  # half full on average, so that chance fills none
    for b in range(n_blocks):
        rows = blocks.where(F.pmod("place", F.lit(n_blocks)) == b).drop("place").collect()
        part = Block(rows, shingle)
        lookups = spark.sparkContext.broadcast(part.lookups())
        counts = docs.select("text").mapInArrow(_counter(lookups), "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).collect()
        chosen = part.choose({(r["k"], r["gram"]): r["n"] for r in counts})
        if b:
            state = materialize(state)
        state = state.mapInArrow(_marker(spark.sparkContext.broadcast(chosen)), schema)
    return state.select(*own, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce(F.length("hits") / 4, F.lit(0)).cast("long").alias("n_hit"), "items")
