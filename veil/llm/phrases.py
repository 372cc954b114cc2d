"""Phrase collocation mining: phrases whose words occur together far more often than apart, for each language.

1. Pages. A task cuts its texts into pieces and words, and packs some megabytes of them as a page: the page's words, each once
   with its count, and its texts as numbers of these words. Pages are checkpointed; texts are read once and never shuffled.
2. Words are counted over all pages. A phrase is no more frequent than any of its words, so only words that are frequent
   enough get ids, and each page is told those of its words.
3. Shards. Each page sorts its runs of up to five words with ids, and builds count automata from them (``automata``), one for
   each range of prefixes. Automata of one range meet in one task, which adds up the weights of equal paths. Ranges are
   chosen from a sample of pages; they decide only where phrases meet. A phrase whose extensions lie in several ranges is
   summed over them.
4. Lookups. Frequent phrases are put in blocks; each block asks for the parts of its phrases, each part once, builds an
   automaton of the answers and composes its phrases' cuts with it.
5. Scores are exact decimals in Spark, the first phrases of each language are found in salted groups first.

A very frequent word, passage or language comes once from each page; a range of prefixes can begin and end inside of any
prefix, so even one word that begins a third of all phrases is spread over many ranges.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm import graph
from veil.llm import words as W
from veil.llm.automata import Automaton, Union, sort_rows
from veil.llm.tables import packed, parts, unpacked
from veil.session import materialize

MOST_WORDS, LEAST, REPORT = 5, 100, 2000
PAGE_BYTES = 16 << 20
#: Phrases of a block, and pages looked at for the ranges.
BLOCK, SAMPLE_PAGES, SAMPLE_ROWS = 1 << 15, 16, 4096

_BREAKS = W.byte_table([*b".,;:!?", *range(10, 14)])
_WORD = ~W.byte_table([*b".,;:!? \t", *range(10, 14)])
_IDS = [f"w{i}" for i in range(1, MOST_WORDS + 1)]
_ID_TYPES = ", ".join(f"{c} long" for c in _IDS)


def _words(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts, where a piece begins, and each word's text."""
    w = W.split(rows.column("text"), _WORD, lower_ascii=True)
    size = w.stops - w.starts
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(w.data[_WORD[w.data]].tobytes()))
    owner = w.owner()
    piece = np.concatenate([np.zeros(1, np.int64), np.cumsum(_BREAKS[w.data])])[w.starts]
    begin = np.ones(len(size), bool)
    begin[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    return words, begin, owner


def _pack_pages(page_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, size, task = 0, 0, TaskContext.get().partitionId()
        held: list[tuple] = []

        def whole_page() -> pa.RecordBatch:
            nonlocal page, size
            words, begin, langs = zip(*held)
            word = pa.chunked_array(words).combine_chunks().dictionary_encode()
            lang = pa.chunked_array(langs).combine_chunks().dictionary_encode()
            code = lang.indices.to_numpy().astype(np.int64) * max(len(word.dictionary), 1) + word.indices.to_numpy()
            entry, number, n = np.unique(code, return_inverse=True, return_counts=True)
            entries = pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(entry // max(len(word.dictionary), 1))), word.dictionary.take(pa.array(entry % max(len(word.dictionary), 1))), pa.array(n.astype(np.int64))],
                ["lang", "word", "n"],
            )
            run_of = pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(np.concatenate(begin))], ["entry", "begin"])
            page, size = page + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + page]), pa.array([packed(entries)], pa.binary()), pa.array([packed(run_of)], pa.binary())], ["page", "entries", "run"])

        for batch in batches:
            for rows in W.slices(batch, "text"):
                words, begin, owner = _words(rows)
                if len(words):
                    held.append((words, begin, rows.column("lang").take(pa.array(owner))))
                    size += words.nbytes
                if size >= page_bytes:
                    yield whole_page()
        if held:
            yield whole_page()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, blob in zip(batch.column("page").to_pylist(), batch.column("entries")):
            entries = unpacked(blob.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(entries.num_rows, page)), pa.array(np.arange(entries.num_rows, dtype=np.int32)), entries.column("lang"), entries.column("word").cast(pa.string()), entries.column("n")],
                ["page", "place", "lang", "word", "n"],
            )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each page (its texts, then its words' ids): all sequences of two to five ids within pieces, the longest from each
    place on, in order, each once; with their counts."""
    for table, first in graph.whole_groups(batches, ["page"], rows=1 << 16):
        place, wid = table.column("place").to_numpy(), table.column("wid").to_numpy()
        for s, e in zip(first.tolist(), first[1:].tolist()):
            run = unpacked(table.column("run")[s].as_py())
            entry, begin = run.column("entry").to_numpy(), run.column("begin").to_numpy(zero_copy_only=False)
            names = np.unique(wid[s + 1 : e])
            of_entry = np.zeros(int(entry.max()) + 1, np.int64)
            of_entry[place[s + 1 : e]] = np.searchsorted(names, wid[s + 1 : e]) + 1
            seq = np.concatenate([of_entry[entry], np.zeros(MOST_WORDS, np.int64)])
            begin = np.concatenate([begin, np.ones(MOST_WORDS, bool)])
            at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0) & ~begin[1:])
            bits = max(len(names), 1).bit_length()
            rows = np.zeros((len(at), MOST_WORDS), np.int64)
            on = np.ones(len(at), bool)
            for d in range(MOST_WORDS):
                if d:
                    on &= ~begin[at + d] & (seq[at + d] > 0)
                rows[:, d] = np.where(on, seq[at + d], 0)
            each = 62 // bits
            keys = []
            for a in range(0, MOST_WORDS, each):
                key = np.zeros(len(at), np.int64)
                for d in range(a, min(a + each, MOST_WORDS)):
                    key = (key << bits) | rows[:, d]
                keys.append(key)
            order = np.lexsort(keys[::-1])
            new = np.ones(len(at), bool)
            new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0) if len(at) else False
            head = np.flatnonzero(new)
            names = np.concatenate([np.full(1, -1), names])
            yield names[rows[order[head]]], np.diff(np.append(head, len(at)))


def _range_sample(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _runs(batches):
            some = rows[np.unique(np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(np.int64))] if len(rows) else rows
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some.T], _IDS)

    return run


def _shards(borders: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Tuples:
            def __init__(self, rows):
                self.rows = rows

            def __len__(self):
                return len(self.rows)

            def __getitem__(self, i):
                return tuple(self.rows[i].tolist())

        for rows, n in _runs(batches):
            cuts = [0, *(bisect_left(Tuples(rows), b) for b in borders), len(rows)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    blob = W.squeezed(Automaton.build(rows[a:b], n[a:b]).dump())
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    return run


def _summed(borders: list[tuple], least: int):
    """Of each range the phrases that are frequent; those that begin a border may go on in other ranges and pass with any count."""

    def result(part: int, union: Union) -> Iterator[pa.RecordBatch]:
        ends = [borders[i] for i in (part - 1, part) if 0 <= i < len(borders)]
        for d in range(1, MOST_WORDS):
            rows, n = union.sums(d)
            keep = n >= least
            for b in ends:
                keep |= (rows == np.array(b[: d + 1])).all(axis=1)
            rows = np.concatenate([rows[keep], np.full((int(keep.sum()), MOST_WORDS - d - 1), -1)], axis=1)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows.T), pa.array(n[keep])], [*_IDS, "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union = None, None
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                if part != now:
                    if now is not None:
                        yield from result(now, union)
                    now, union = part, Union(MOST_WORDS)
                union.add(Automaton.load(W.unsqueezed(blob.as_py())))
        if now is not None:
            yield from result(now, union)

    return run


def _all_cuts(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each k: which rows have more than k words, their first k and the rest, ended by -1."""
    for k in range(1, MOST_WORDS):
        some = np.flatnonzero(rows[:, k] >= 0)
        left = np.where(np.arange(MOST_WORDS - 1) < k, rows[some, : MOST_WORDS - 1], -1)
        right = np.concatenate([rows[some, k:], np.full((len(some), k), -1)], axis=1)[:, : MOST_WORDS - 1]
        yield k, some, left, right


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            some = batch.slice(a, BLOCK)
            rows = np.stack([some.column(c).to_numpy() for c in _IDS], axis=1)
            asked = np.unique(np.concatenate([x for _, _, left, right in _all_cuts(rows) for x in (left, right)]), axis=0)
            number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number]), pa.array([packed(pa.RecordBatch.from_arrays([pa.array(x) for x in asked.T], _IDS[:-1]))], pa.binary()), pa.array([packed(some)], pa.binary())],
                ["block", "asked", "rows"],
            )


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("asked")):
            asked = unpacked(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(asked.num_rows, block)), *asked.columns], ["block", *_IDS[:-1]])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block (its phrases first, then the parts it asked for) to phrases with the counts of their parts."""
    for table, first in graph.whole_groups(batches, ["block"], rows=1 << 16):
        ids = np.stack([table.column(c).to_numpy() for c in _IDS[:-1]], axis=1)
        f = table.column("f").to_numpy()
        for s, e in zip(first.tolist(), first[1:].tolist()):
            phrases = unpacked(table.column("rows")[s].as_py())
            rows = np.stack([phrases.column(c).to_numpy() for c in _IDS], axis=1)
            known = Automaton.build(*sort_rows(ids[s + 1 : e], f[s + 1 : e]), total=False)
            size = (rows >= 0).sum(axis=1)
            counts = np.zeros((2, len(rows), MOST_WORDS - 1), np.int64)
            for k, some, left, right in _all_cuts(rows):
                counts[0, some, k - 1] = known.weights_of(left)
                counts[1, some, k - 1] = known.weights_of(right)
            inside = np.arange(MOST_WORDS - 1) < size[:, None] - 1
            borders = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
            words = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), rows[rows >= 0])
            yield pa.RecordBatch.from_arrays([words, phrases.column("f"), *(pa.ListArray.from_arrays(borders, c[inside]) for c in counts)], ["w", "a", "ls", "rs"])


def _numbered(docs: DataFrame, least: int, page_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, their words' counts, and the frequent words with ids."""
    pages = materialize(docs.mapInArrow(_pack_pages(page_bytes), "page long, entries binary, run binary"))
    entries = pages.select("page", "entries").mapInArrow(_entries, "page long, place int, lang string, word string, n long")
    frequent = entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return pages, entries, materialize(frequent.withColumn("wid", F.monotonically_increasing_id()))


def frequent_phrases(pages: DataFrame, entries: DataFrame, frequent: DataFrame, least: int, n_parts: int) -> DataFrame:
    """w1 to w5 (ids of words, -1 after the last) and f for each phrase of two words or more that occurs often enough."""

    def numbered(some: DataFrame, words: DataFrame) -> DataFrame:
        """Pages, dealt out whole: texts first, then their words' ids."""
        told = words.join(frequent.select("lang", "word", "wid"), ["lang", "word"]).select("page", "place", "wid", F.lit(None).cast("binary").alias("run"))
        heads = some.select("page", F.lit(-1).alias("place"), F.lit(-1).cast("long").alias("wid"), "run")
        return told.unionByName(heads).repartition(n_parts, "page").sortWithinPartitions("page", "place")

    chosen = F.col("page").isin([r["page"] for r in pages.select("page").orderBy(F.xxhash64("page"), "page").limit(SAMPLE_PAGES).collect()])
    seen = sorted(tuple(r) for r in numbered(pages.where(chosen), entries.where(chosen)).mapInArrow(_range_sample(SAMPLE_ROWS), _ID_TYPES).collect())
    n_ranges = 4 * n_parts
    borders = sorted({seen[i * len(seen) // n_ranges] for i in range(1, n_ranges)}) if seen else []
    shards = numbered(pages, entries).mapInArrow(_shards(borders), "part int, blob binary")
    summed = shards.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_summed(borders, least), f"{_ID_TYPES}, f long")
    return materialize(summed.groupBy(*_IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least))


def with_parts(grams: DataFrame, frequent: DataFrame, n_parts: int) -> DataFrame:
    """w (ids), a (count), ls and rs (counts of the first k words and of the rest, for each k) for each frequent phrase."""
    blocks = materialize(grams.mapInArrow(_blocks, "block long, asked binary, rows binary"))
    none = F.lit(-1).cast("long")
    counts = grams.where("w5 = -1").select(*_IDS[:-1], "f").unionByName(frequent.select(F.col("wid").alias("w1"), *(none.alias(c) for c in _IDS[1:-1]), "f"))
    answers = blocks.select("block", "asked").mapInArrow(_asked, "block long, " + ", ".join(f"{c} long" for c in _IDS[:-1])).join(counts, _IDS[:-1])
    heads = blocks.select("block", *(none.alias(c) for c in _IDS[:-1]), F.lit(0).cast("long").alias("f"), "rows")
    both = answers.select("block", *_IDS[:-1], "f", F.lit(None).cast("binary").alias("rows")).unionByName(heads)
    both = both.repartition(n_parts, "block").sortWithinPartitions("block", "w1", F.col("rows").isNull())
    return both.mapInArrow(_composed, "w array<long>, a long, ls array<long>, rs array<long>")


def best_cut() -> Column:
    """struct(score, k, l, r) of the cut of lowest score, the first of equal ones; exact up to counts of 10^16 and products of 10^38."""
    score = "cast((1000 * cast(a AS decimal(16,0)) * cast(n AS decimal(18,0))) div (cast(ls[k] AS decimal(18,0)) * cast(rs[k] AS decimal(18,0))) AS bigint)"
    return F.expr(f"array_min(transform(sequence(0, size(ls) - 1), k -> struct({score} AS score, k AS k, ls[k] AS l, rs[k] AS r)))")


def collocations(docs: DataFrame, least: int = LEAST, report: int = REPORT, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language of ``docs`` (text, lang) the first ``report`` phrases of two to five
    words that occur ``least`` times or more, by score, then a, then the phrase's bytes.

    Null languages count as ``und``; null and empty texts have no words, and a language without words isn't in the result.
    A very long text is a page of its own. Repeated rows count each. Cuts of equal score: the one after fewer words.
    An empty table gives an empty result; further columns are ignored.
    """
    n_parts = parts(docs)
    pages, entries, frequent = _numbered(docs.select(F.col("text").cast("string").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")), least, page_bytes)
    sizes = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    grams = frequent_phrases(pages, entries, frequent, least, n_parts)
    found = materialize(with_parts(grams, frequent, n_parts))

    # a phrase of m words is in longer ones as often as it occurs just if that holds for one of m + 1 words
    longer = found.where(F.size("w") > 2)
    head = longer.where(F.col("a") >= F.element_at("ls", -1)).select(F.slice("w", F.lit(1), F.size("w") - 1).alias("w"))
    tail = longer.where(F.col("a") >= F.element_at("rs", 1)).select(F.slice("w", F.lit(2), F.size("w") - 1).alias("w"))
    left = found.join(head.unionByName(tail).distinct(), "w", "left_anti")
    left = left.join(frequent.select(F.col("wid"), "lang"), F.col("w")[0] == F.col("wid")).join(sizes, "lang")
    scored = left.withColumn("best", best_cut()).select("lang", "w", "a", "n", "best.l", "best.r", "best.score")

    for groups in (64, 1):  # first in salted groups of a language, then among what is left of each
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(groups)))
        scored = salted.selectExpr("*", "rank() OVER (PARTITION BY lang, salt ORDER BY score DESC, a DESC) AS place").where(F.col("place") <= report).drop("place", "salt")
    scored = scored.withColumn("key", F.concat_ws(" ", F.transform("w", lambda x: x.cast("string"))))
    named = scored.select("key", "lang", F.posexplode("w").alias("pos", "wid")).join(frequent.select("wid", "word"), "wid")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("key").agg(phrase.alias("phrase"))
    final = scored.join(named, "key").selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank")
    return final.where(F.col("rank") <= report).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
