"""Removing repeated passages: windows of 13 words that also start in a document with a smaller id.

Super-k-mer partitioning. The minimiser of a window is the smallest hash of its runs of ``GRAM`` words. Consecutive
windows that share it travel as one packed string, their words joined, to the bucket of the minimiser; equal windows
share their minimiser and so meet there. A bucket unpacks its strings, sorts the windows by hash and document, and marks
each window that a smaller document has too. Marks go back to the documents as word ranges.

Before strings leave a task, equal strings of the rows it holds are merged into the one with the smallest id; the others
are marked at once, as a smaller document has all their windows. So a passage that a third of all rows share leaves each
task once. A minimiser that very many different windows share (a common phrase) would make a hot bucket: such minimisers
are looked for in a sample, and windows under them are dealt by the hash of the whole window instead. The sample decides
only where windows meet, never which are compared.

Windows are compared by the 64-bit hashes of their 13 words. A mark names its row by id and a short hash of the text, and
carries a hash of the words it covers: rows that share the id and the short hash take only marks of words they have there.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import words as W
from veil.llm.tables import parts

WINDOW, GRAM = 13, 3
#: Packed strings a task holds before it sends them, in bytes.
FLUSH_BYTES = 30 << 20
#: What a mark and a further place of a string take of that.
MARK_BYTES, PLACE_BYTES = 48, 300
#: Marks that travel together.
MARKS = 1 << 14
LEVEL = 6
#: Documents sampled for common minimisers, and the share of them from which a minimiser counts as common.
SAMPLE_ROWS, COMMON = 4000, 0.004
#: A null id counts as the largest.
_LAST = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the n values from each place on, by doubling; the last n - 1 places hold nothing of use."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out, np.concatenate([out[step:], out[len(out) - step :]]))
        have += step
    return out


def _routes(w: W.Words, hashes: np.ndarray, window: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the number that decides where each window goes."""
    at = np.flatnonzero(w.room() >= window)
    route = sliding_min(W.runs(hashes, GRAM), window - GRAM + 1)[at]
    if len(common) and len(at):
        found = np.minimum(np.searchsorted(common, route), len(common) - 1)
        often = common[found] == route
        if often.any():
            route = np.where(often, W.runs(hashes, window)[at], route)
    return at, route


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)


def _packed_marks(marks: np.ndarray) -> bytes:
    """Marks in order of documents, column by column, as differences where neighbours are alike."""
    doc, rest = marks[:, 0], marks[:, 1:].astype(np.int32)
    rest = np.stack([np.diff(rest[:, 0], prepend=np.int32(0)), np.diff(rest[:, 1], prepend=np.int32(0)), rest[:, 2] - rest[:, 1], rest[:, 3]])
    return np.diff(doc, prepend=np.int64(0)).tobytes() + rest.tobytes()


def _unpacked_marks(raw: bytes) -> np.ndarray:
    n = len(raw) // 24
    rest = np.frombuffer(raw, np.int32, 4 * n, offset=8 * n).reshape(4, n)
    first = np.cumsum(rest[1], dtype=np.int32)
    return np.stack([np.cumsum(np.frombuffer(raw, np.int64, n)), np.cumsum(rest[0], dtype=np.int32), first, first + rest[2], rest[3]], axis=1).astype(np.int64)


class _Sender:
    """Collects packed strings by their text, and hands them out bucket by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.best: dict[bytes, tuple[int, int, set]] = {}  # text: bucket, smallest document, where it has the text
        self.marked = array("q")  # document, key, first word, end, hash; one mark after the other

    def add(self, text: bytes, bucket: int, doc: int, place: tuple[int, int, int, int]) -> None:
        """``place``: the row's key, first word, end, and the hash of these words."""
        have = self.best.get(text)
        if have is None:
            self.best[text] = (bucket, doc, {place})
            self.size += len(text) + 300
        elif have[1] < doc:
            self.marked.extend((doc, *place))
            self.size += MARK_BYTES
        elif have[1] > doc:
            self.best[text] = (bucket, doc, {place})
            for x in have[2]:
                self.marked.extend((have[1], *x))
            self.size += MARK_BYTES * len(have[2])
        else:
            have[2].add(place)
            self.size += PLACE_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        by: dict[int, list] = {}
        for text, (bucket, doc, places) in self.best.items():
            by.setdefault(bucket, []).extend((text, doc, key, first) for key, first, *_ in sorted(places))
        for bucket, items in by.items():
            doc = np.array([x[1] for x in items], np.int64)
            head = np.array([(key, first, len(text)) for text, _, key, first in items], np.int32).T
            # ids as differences: within a task they are near each other as a rule
            blob = pack.compress(np.diff(doc, prepend=np.int64(0)).tobytes() + head.tobytes() + b"".join(x[0] for x in items))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(items)], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "n", "blob"])
        if self.marked:
            marked = np.frombuffer(self.marked, np.int64).reshape(-1, 5)
            # split by document, into as many parts as keep each at a few thousand marks
            spot = W.mix(marked[:, 0].view(np.uint64)) % np.uint64(len(marked) // MARKS + 1)
            order = np.lexsort((marked[:, 2], marked[:, 1], marked[:, 0], spot))
            borders = np.flatnonzero(np.diff(spot[order].astype(np.int64), prepend=-1, append=-1))
            for x, y in zip(borders.tolist(), borders[1:].tolist()):
                some = marked[order[x:y]]
                bucket = int(W.mix(some[:1, 0].view(np.uint64))[0] % np.uint64(self.buckets))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([pack.compress(_packed_marks(some))], pa.binary())], ["bucket", "n", "blob"])
        self.best, self.marked, self.size = {}, array("q"), 0


def _send(buckets: int, window: int, common) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        out = _Sender(buckets)
        for batch in batches:
            for rows in W.slices(batch, "text"):
                w = W.split(rows.column("text"), W.SPACED)
                hashes = w.hashes()
                at, route = _routes(w, hashes, window, often)
                if not len(at):
                    continue
                owner = np.searchsorted(w.first, at, side="right") - 1
                new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(route, prepend=route[:1]) != 0) | (np.diff(owner, prepend=-1) != 0))
                windows = np.diff(np.append(new, len(at)))
                a = at[new]
                begin, end = w.starts[a].tolist(), w.stops[a + windows + window - 2].tolist()
                doc, key = _ids(rows)[owner[new]].tolist(), rows.column("key").to_numpy()[owner[new]].tolist()
                bucket = (W.mix(route[new]) % np.uint64(buckets)).tolist()
                body = w.data.tobytes()
                first = a - w.first[owner[new]]
                covered = _short(W.stretch_hash(hashes, a, a + windows + window - 1)).tolist()
                for s, e, b, d, *place in zip(begin, end, bucket, doc, key, first.tolist(), (first + windows + window - 1).tolist(), covered):
                    out.add(body[s:e], b, d, tuple(place))
                    if out.size > FLUSH_BYTES:
                        yield from out.rows()
        yield from out.rows()

    return run


def _bucket(blobs: list[tuple[int, bytes]], window: int) -> Iterator[np.ndarray]:
    """Marked word ranges (doc, key, first word, end, hash of the words) of one bucket."""
    unpack = zstandard.ZstdDecompressor()
    heads, texts = [], []
    for n, blob in blobs:
        raw = unpack.decompress(blob)
        if not n:
            yield _unpacked_marks(raw)
            continue
        head = np.frombuffer(raw, np.int32, 3 * n, offset=8 * n).reshape(3, n)
        heads.append(np.stack([np.cumsum(np.frombuffer(raw, np.int64, n)), *head.astype(np.int64)]))
        texts.append(raw[20 * n :])
    if not heads:
        return
    doc, key, first, size = np.concatenate(heads, axis=1)
    body = b"".join(texts)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    w = W.split(pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)), W.SPACED)
    hashes = w.hashes()
    at = np.flatnonzero(w.room() >= window)
    which = np.searchsorted(w.first, at, side="right") - 1
    grams = W.runs(hashes, window)[at]
    order = np.lexsort((doc[which], grams))
    grams, at, which = grams[order], at[order], which[order]
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    head = np.repeat(head, np.diff(np.append(head, len(grams))))
    hit = doc[which] > doc[which[head]]
    hit_at, ref = at[hit], at[head][hit]
    same = np.ones(len(hit_at), bool)
    for j in range(window):
        same &= hashes[hit_at + j] == hashes[ref + j]
    if not same.all():  # two windows under one hash: sort these by their words
        wrong = np.isin(grams, np.unique(grams[hit][~same]))
        smallest: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong).tolist():
            t = hashes[at[i] : at[i] + window].tobytes()
            smallest[t] = min(smallest.get(t, _LAST), int(doc[which[i]]))
        for i in np.flatnonzero(wrong).tolist():
            hit[i] = doc[which[i]] > smallest[hashes[at[i] : at[i] + window].tobytes()]
    at, which = at[hit], which[hit]
    order = np.argsort(at)
    at, which = at[order], which[order]
    if not len(at):
        return
    start = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(which, prepend=-1) != 0))
    stop = np.append(start[1:], len(at)) - 1
    base = first[which[start]] - w.first[which[start]]
    covered = _short(W.stretch_hash(hashes, at[start], at[stop] + window))
    yield np.unique(np.stack([doc[which[start]], key[which[start]], at[start] + base, at[stop] + base + window, covered], axis=1), axis=0)


def _meet(window: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[np.ndarray]:
            now, blobs = None, []
            for batch in batches:
                for bucket, n, blob in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("blob")):
                    if bucket != now and blobs:
                        yield from _bucket(blobs, window)
                        blobs = []
                    now = bucket
                    blobs.append((n, blob.as_py()))
            if blobs:
                yield from _bucket(blobs, window)

        for found in ranges():
            # one row for a document: its ranges, each with the hash of its words
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            new = np.flatnonzero((np.diff(found[:, 0], prepend=found[0, 0] - 1) != 0) | (np.diff(found[:, 1], prepend=found[0, 1] - 1) != 0))
            ranges_of = found[:, 2:].astype(np.int32)
            blobs = [ranges_of[a:b].tobytes() for a, b in zip(new.tolist(), [*new[1:].tolist(), len(found)])]
            doc = found[new, 0]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=doc == _LAST), pa.array(found[new, 1].astype(np.int32)), pa.array(blobs, pa.binary())], ["m_id", "m_key", "ranges"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept text of each row, its words joined by one space, with counts and digest."""
    for batch in batches:
        for rows in W.slices(batch, "text"):
            w = W.split(rows.column("text"), W.SPACED)
            n = len(w.starts)
            change = np.zeros(n + 1, np.int64)
            hashes = None
            for i, ranges in enumerate(rows.column("ranges").to_pylist()):
                if ranges:
                    hashes = w.hashes() if hashes is None else hashes
                    a, b, covered = np.frombuffer(b"".join(ranges), np.int32).reshape(-1, 3).T
                    a, b = a + w.first[i], b + w.first[i]
                    own = b <= w.first[i + 1]
                    a, b, covered = a[own], b[own], covered[own]
                    own = _short(W.stretch_hash(hashes, a, b)) == covered
                    np.add.at(change, a[own], 1)
                    np.add.at(change, b[own], -1)
            keep = np.flatnonzero(np.cumsum(change)[:n] == 0)
            owner = w.owner()[keep]
            last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(keep) else np.zeros(0, bool)
            data = np.append(w.data, np.uint8(32))
            data[w.stops[keep[~last]]] = 32
            size = len(data)
            change = np.zeros(size + 1, np.int8)
            change[w.starts[keep]] += 1
            change[w.stops[keep] + ~last] -= 1
            body = data[np.cumsum(change[:size], dtype=np.int8).astype(bool)].tobytes()
            kept = np.bincount(owner, minlength=rows.num_rows)
            bytes_of = np.bincount(owner, weights=w.stops[keep] - w.starts[keep] + ~last, minlength=rows.num_rows).astype(np.int64)
            ends = np.cumsum(bytes_of).tolist()
            texts = [body[e - s : e] for s, e in zip(bytes_of.tolist(), ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(w.counts - kept),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )


def common_minimisers(docs: DataFrame, window: int, rows: int = SAMPLE_ROWS, share: float = COMMON) -> np.ndarray:
    """Minimisers that many sampled documents have; at most ``rows`` or so documents are looked at, in the tasks."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    sample = docs.select("doc_id", "text").sample(fraction=min(1.0, rows / total), seed=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.split(part.column("text"), W.SPACED)
                at, route = _routes(w, w.hashes(), window, np.zeros(0, np.uint64))
                owner = (np.searchsorted(w.first, at, side="right") - 1).astype(np.uint64)
                values, n = np.unique(np.unique(np.stack([owner, route]), axis=1)[1], return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["route", "n"])

    many = max(8, share * min(rows, total))
    found = sample.mapInArrow(count, "route long, n long").groupBy("route").agg(F.sum("n").alias("n")).where(F.col("n") >= many).select("route").collect()
    return np.sort(np.array([r["route"] for r in found], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``kept`` (the words left, joined by one space) for each row of
    ``docs`` (doc_id, text).

    Null texts and texts under 13 words lose nothing. Rows with the same id are judged each on its own and take nothing
    from each other; a null id counts as the largest. An empty table gives an empty result.
    """
    buckets = 4 * parts(docs)
    keyed = docs.select("doc_id", "text", F.hash("text").alias("key"))
    common = docs.sparkSession.sparkContext.broadcast(common_minimisers(docs, window))
    packed = keyed.mapInArrow(_send(buckets, window, common), "bucket int, n int, blob binary")
    ranges = packed.repartition(parts(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(window), "m_id long, m_key int, ranges binary")
    ranges = ranges.groupBy("m_id", "m_key").agg(F.collect_set("ranges").alias("ranges"))
    marked = keyed.join(ranges, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select("doc_id", "text", "ranges")
    return marked.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
