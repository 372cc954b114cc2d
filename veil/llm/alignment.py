"""Cross-tokenizer alignment: which tokens of one tokenizer stand for the same bytes as which of another.

1. A task encodes its texts by both tokenizers, a few megabytes at a time; stretches between seams that neither can cross
   are encoded once and remembered. Interval coalescing: all tokens are lexsorted by
   their first byte, the running maximum of the ends is taken, and a group breaks where a token starts at that maximum.
   Tokens of a group are linked all with all (``_links``), so a group is the smallest stretch both tokenizers cut out alike.
2. Each document's distinct links go into a page, some megabytes of text of one task: a list of the page's distinct id
   pairs, each once, with the number of documents that hold it, and for each document places in that list. Pages are
   checkpointed; texts are never shuffled and encoded only once.
3. The pages' pairs are summed over the corpus by a grouping, and each A id's highest count is taken from the sums. The sums
   go back to the pages by an equi-join, one row for each pair of a page, and each page adds them up for its documents.

What is shuffled is the distinct pairs of a page, not links, so a pair that every document holds comes once from each page.
The only thing sent to all tasks is the highest count of each A id, bounded by that vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import graph
from veil.llm import words as W
from veil.llm.tables import packed, parts, unpacked
from veil.session import materialize

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text of a page, in bytes. It decides how often a pair is sent, not what is counted.
PAGE_BYTES = 24 << 20
#: Texts a task remembers the tokens of, in bytes; it decides what is encoded again.
REMEMBERED = 64 << 20
#: Links expanded at once; a larger group is counted by its distinct ids.
EXPAND = 1 << 21

_STATS = ["n_a", "n_b", "n_groups", "n_links"]
_PAGES = "page long, pairs binary, docs binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_characters() -> dict[str, int]:
    """The printable character by which byte-level BPE writes each byte: bytes that print stand for themselves, the others are numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """One tokenizer: encodes texts, and knows each id's bytes."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)


class ByteLevel(_Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        characters = _byte_characters()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(characters[c] for c in n) if all(c in characters for c in n) else n.encode() for n in names])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces(_Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def _sides(folder: str) -> tuple[_Side, _Side]:
    return ByteLevel(os.path.join(folder, BYTE_BPE)), Pieces(os.path.join(folder, PIECES))


#: A space after a sign of ASCII or a letter of Latin-1, before such a letter. Both tokenizers begin a token at it whatever stands
#: around it: byte-level BPE splits there before it merges, and no piece holds a space after another character (``Memory`` looks).
_SEAM = re.compile(r" (?<=[!-~À-ÖØ-öø-ÿ] )(?=[A-Za-zÀ-ÖØ-öø-ÿ])")


def _spread(first: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values ``first[w]`` to ``first[w + 1]`` of each w of ``which``, one after the other, and how many each has."""
    n = np.diff(first)[which]
    return values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[which], n)], n


class Memory:
    """Encodes texts stretch by stretch between seams, and remembers what it has encoded; forgets all beyond a size."""

    def __init__(self, folder: str, most: int = REMEMBERED):
        self.sides, self.most = _sides(folder), most
        self.seams = not any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.sides[1].tokens)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.size, self.fits = 0, np.zeros(0, bool)
        self.pools = [(np.zeros(1, np.int64), np.zeros(0, np.int64)) for _ in self.sides]

    def _learn(self, new: list[str]) -> None:
        ids = [s.encode(new) for s in self.sides]
        whole = [(" " + t).encode("utf-8", "surrogatepass") for t in new]
        joined = [[b"".join(map(s.tokens.__getitem__, x)) for x in each] for s, each in zip(self.sides, ids)]
        self.fits = np.concatenate([self.fits, np.array([w == x == y for w, x, y in zip(whole, *joined)], bool)])
        for i, each in enumerate(ids):
            first, pool = self.pools[i]
            ends = first[-1] + np.cumsum([len(x) for x in each], dtype=np.int64)
            self.pools[i] = np.concatenate([first, ends]), np.concatenate([pool, np.fromiter(chain.from_iterable(each), np.int64)])
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        self.size += sum(map(len, whole)) + 200 * len(new)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side: the ids of all texts, and the borders of the texts. A text that doesn't come back byte for byte has none."""
        if self.size > self.most:
            self.forget()
        cut = [(_SEAM.split(t) if self.seams else [t]) if t else [] for t in texts]
        known = self.numbers
        new = list(dict.fromkeys(c for c in chain.from_iterable(cut) if c not in known))
        if new:
            self._learn(new)
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        bad = np.zeros(len(texts), bool)
        bad[owner[~self.fits[which]]] = True
        which, owner = which[~bad[owner]], owner[~bad[owner]]
        out = []
        for first, pool in self.pools:
            ids, n = _spread(first, pool, which)
            tokens = np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
            out.append((ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(tokens)])))
        return out


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, for tokens that cover the same bytes without gaps."""
    n = len(size_a)
    ends = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
    starts = ends - np.concatenate([size_a, size_b])
    order = np.lexsort((np.arange(len(starts)) >= n, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order[1:]] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[:n], group[n:]


def _links(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, owner: np.ndarray, n_b: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links of each document as ``document * span + a * n_b + b``, sorted, and how often each occurs.

    Groups have borders ``first_a`` and ``first_b`` and belong to the documents ``owner``. Some millions of links are
    expanded at once; a group of more is counted by its distinct ids, which their vocabularies bound.
    """
    count_a, count_b = np.diff(first_a), np.diff(first_b)
    todo = count_a * count_b
    codes, often = [], []
    large = todo > EXPAND
    for g in np.flatnonzero(large).tolist():
        x, x_n = np.unique(a[first_a[g] : first_a[g + 1]], return_counts=True)
        y, y_n = np.unique(b[first_b[g] : first_b[g + 1]], return_counts=True)
        codes.append((owner[g] * span + x[:, None] * n_b + y).ravel())
        often.append((x_n[:, None] * y_n).ravel())
    todo = np.where(large, 0, todo)
    borders = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(todo) // EXPAND)) + 1, [len(todo)]])
    for s, e in zip(borders[:-1].tolist(), borders[1:].tolist()):
        at = np.arange(first_a[s], first_a[e])
        group = np.repeat(np.arange(s, e), count_a[s:e])
        partners = np.where(large[group], 0, count_b[group])
        place = np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners - first_b[group], partners)
        code, n = np.unique(np.repeat(owner[group] * span + a[at] * n_b, partners) + b[place], return_counts=True)
        codes.append(code)
        often.append(n)
    code, back = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.zeros(len(code), np.int64)
    np.add.at(total, back, np.concatenate(often) if often else total)
    return code, total


def _digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups written out; ``tokens``: how many A and B tokens each document has."""
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    side, ids = side[order], np.concatenate([a, b])[order]
    last = np.ones(len(ids), bool)
    last[:-1] = side[1:] != side[:-1]
    width = len(str(int(ids.max()))) if len(ids) else 1
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = np.empty((len(ids), width + 1), np.uint8)
    shown[:, :width] = ids[:, None] // powers % 10 + ord("0")
    shown[:, width] = np.where(last, np.where(side % 2, ord(";"), ord("|")), ord(","))
    keep = np.ones(shown.shape, bool)
    keep[:, : width - 1] = ids[:, None] >= powers[:-1]
    body = shown[keep].tobytes()
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep.sum(axis=1))])[np.concatenate([np.zeros(1, np.int64), np.cumsum(tokens)])].tolist()
    return [hashlib.sha256(body[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]


def _align(texts: list[str], memory: Memory) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For some texts: their counts (rows as ``_STATS``), digests, and distinct links with how often they occur."""
    side_a, side_b = memory.sides
    (a, text_a), (b, text_b) = memory.encode(texts)
    group_a, group_b = coalesce(side_a.sizes[a], side_b.sizes[b])
    groups = int(group_a[-1]) + 1 if len(a) else 0
    first_a, first_b = (np.searchsorted(g, np.arange(groups + 1)) for g in (group_a, group_b))
    owner = np.searchsorted(text_a, first_a[:-1], side="right") - 1
    n_links = np.bincount(owner, weights=np.diff(first_a) * np.diff(first_b), minlength=len(texts)).astype(np.int64)
    stats = np.stack([np.diff(text_a), np.diff(text_b), np.bincount(owner, minlength=len(texts)), n_links])
    code, often = _links(a, b, first_a, first_b, owner, len(side_b.tokens), len(side_a.tokens) * len(side_b.tokens))
    return stats, _digests(a, b, group_a, group_b, stats[0] + stats[1]), code, often


def _encode(folder: str, page_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(folder)
        n_b = len(memory.sides[1].tokens)
        span = len(memory.sides[0].tokens) * n_b
        page, task = 0, TaskContext.get().partitionId()
        held: list[tuple] = []

        def whole_page() -> pa.RecordBatch:
            nonlocal page
            ids, stats, digests, n_docs, code, often = zip(*held)
            pair, place, docs = np.unique(np.concatenate([c % span for c in code]), return_inverse=True, return_counts=True)
            before = np.cumsum([0, *n_docs[:-1]])
            first = np.searchsorted(np.concatenate([c // span + x for c, x in zip(code, before)]), np.arange(sum(n_docs) + 1)).astype(np.int32)
            rows = pa.RecordBatch.from_arrays(
                [pa.chunked_array(ids).combine_chunks(), *(pa.array(x) for x in np.concatenate(stats, axis=1)), pa.array(sum(digests, [])),
                 pa.ListArray.from_arrays(first, place.astype(np.int32)), pa.ListArray.from_arrays(first, np.concatenate(often))],
                ["doc_id", *_STATS, "groups_sha256", "place", "often"],
            )
            pairs = pa.RecordBatch.from_arrays([pa.array(pair // n_b), pa.array(pair % n_b), pa.array(docs.astype(np.int64))], ["a", "b", "docs"])
            held.clear()
            page += 1
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + page]), pa.array([packed(pairs)], pa.binary()), pa.array([packed(rows)], pa.binary())], ["page", "pairs", "docs"])

        size = 0
        for batch in batches:
            for rows in W.slices(batch, "text"):
                stats, digests, code, often = _align(pc.fill_null(rows.column("text"), "").to_pylist(), memory)
                held.append((rows.column("doc_id"), stats, digests, rows.num_rows, code, often))
                size += rows.column("text").nbytes
                if size >= page_bytes:
                    yield whole_page()
                    size = 0
        if held:
            yield whole_page()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, blob in zip(batch.column("page").to_pylist(), batch.column("pairs")):
            pairs = unpacked(blob.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(pairs.num_rows, page)), pa.array(np.arange(pairs.num_rows, dtype=np.int32)), *pairs.columns], ["page", "place", "a", "b", "docs"]
            )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a page (its documents first, then its pairs in order) to rows of documents."""
    for table, first in graph.whole_groups(batches, ["page"], rows=1 << 16):
        count, best = table.column("count").to_numpy(), table.column("best").to_numpy()
        for s, e in zip(first.tolist(), first[1:].tolist()):
            rows = unpacked(table.column("rows")[s].as_py())
            count_of, best_of = count[s + 1 : e], best[s + 1 : e]
            borders = rows.column("place").offsets.to_numpy()
            place, often = rows.column("place").values.to_numpy(), rows.column("often").values.to_numpy()
            added = [np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[borders] for x in (often * best_of[place], often * count_of[place])]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(rows.column(c) for c in _STATS), *(pa.array(np.diff(x)) for x in added), rows.column("groups_sha256")],
                ["doc_id", *_STATS, "n_best", "count_sum", "groups_sha256"],
            )


def encoded_pages(docs: DataFrame, folder: str = TOKENIZERS, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) encoded and linked, as checkpointed pages: packed pairs and packed documents."""
    return materialize(docs.mapInArrow(_encode(folder, page_bytes), _PAGES))


def _exploded(pages: DataFrame) -> DataFrame:
    return pages.select("page", "pairs").mapInArrow(_pairs, "page long, place int, a long, b long, docs long")


def pair_counts(pages: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (no pair of a has more): one row for each linked pair of ids."""
    counts = materialize(_exploded(pages).groupBy("a", "b").agg(F.sum("docs").alias("count")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # at most one row for each id of A's vocabulary
    return counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, folder: str = TOKENIZERS, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_a, n_b (its tokens by the tokenizers A and B), n_groups, n_links, n_best,
    count_sum, groups_sha256 (digest of the groups' ids).

    Texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no tokens: zeros and an empty
    digest. Each row counts as a document, also when it repeats an id or a text; ids may be null. Of an A id's pairs all
    that reach its highest count are best. A very long text is encoded whole, as a page of its own. An empty table gives
    an empty result; further columns are ignored. ``folder``, with the tokenizers' files, is read by each task.
    """
    pages = encoded_pages(docs.select("doc_id", "text"), folder, page_bytes)
    rows = _exploded(pages).join(pair_counts(pages), ["a", "b"]).select("page", "place", "count", F.col("best").cast("long").alias("best"), F.lit(None).cast("binary").alias("rows"))
    heads = pages.select("page", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("best"), F.col("docs").alias("rows"))
    return rows.unionByName(heads).repartition(parts(docs), "page").sortWithinPartitions("page", "place").mapInArrow(_sums, _RESULT)
