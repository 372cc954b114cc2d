"""Cross-tokenizer alignment against a plain walk over byte offsets."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import alignment

TEXTS = [
    "The quick brown fox, jumping over 12345 lazy dogs.", "naïve café – 東京タワー กขค 😀👍", "  two  spaces\tand\ttabs \n\n newlines ", "", None, "a" * 700,
    "<|endoftext|> and <s> </s> <unk> are plain text here", "▁ is kept by one side only", "same text", "same text", "=-" * 400 + " ----- " * 30, "ǆ ﬁ Å nfkc?", "it's they'll 's we 're a  b   c \u00a0 d\u2003e f\u0301 g \u0301 h", " lead", "trail ", "é à ÿ÷ x × y 1 2 3a b4 ... a - b", "x\u200b y\u00ad z",
]


def brute(rows):
    side_a, side_b = alignment._sides(alignment.TOKENIZERS)
    docs = []
    for _, text in rows:
        a, b = side_a.encode([text or ""])[0], side_b.encode([text or ""])[0]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(side_a.tokens[i] for i in a) != whole or b"".join(side_b.tokens[i] for i in b) != whole:
            docs.append((0, 0, []))
            continue
        ends = []
        for side, ids in ((side_a, a), (side_b, b)):
            at, out = 0, []
            for i in ids:
                at += len(side.tokens[i])
                out.append(at)
            ends.append(out)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(a) and ends[0][i] <= cut:
                x.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                y.append(b[j])
                j += 1
            groups.append((x, y))
        docs.append((len(a), len(b), groups))
    count, top = defaultdict(int), defaultdict(int)
    for _, _, groups in docs:
        for pair in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            count[pair] += 1
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), (n_a, n_b, groups) in zip(rows, docs):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_alignment_by_brute_force(spark):
    rows = [*enumerate(TEXTS), (None, "an id that is null"), (3, "a repeated id"), (8, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"a": F.lit(1), "page": F.lit("x")})
    assert result(alignment.align(docs, page_bytes=200)) == brute(rows)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(alignment.align(docs, page_bytes=1 << 17)) == brute([tuple(r) for r in docs.collect()])


def test_long_text_and_large_group(spark, monkeypatch):
    rows = [(1, "word " * 40_000 + "é" * 3000), (2, "x")]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(alignment.align(docs)) == want
    # all groups as large ones, in this process
    texts = [t for _, t in rows]
    usual = alignment._align(texts, alignment.Memory(alignment.TOKENIZERS))
    for most in (0, 3, 50):
        monkeypatch.setattr(alignment, "EXPAND", max(most, 1))
        other = alignment._align(texts, alignment.Memory(alignment.TOKENIZERS))
        assert all(np.array_equal(x, y) for x, y in zip(usual, other))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sizes", [([1, 2, 3], [3, 3]), ([5], [1, 1, 1, 1, 1]), ([2, 2], [1, 2, 1])])
def test_groups_cover_the_same_bytes(sizes):
    a, b = (np.array(s) for s in sizes)
    x, y = alignment.coalesce(a, b)
    assert np.array_equal(np.bincount(x, weights=a), np.bincount(y, weights=b))


def test_memory_gives_the_same_ids(spark):
    """Stretches encoded apart, remembered, forgotten and learnt again, against whole texts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()
    texts = [r["text"] or "" for r in rows] + [t or "" for t in TEXTS] + ["".join(np.random.default_rng(i).choice(list("ab \'.1é\t\n$ÿ　ﬁ "), 200)) for i in range(300)]
    for most in (1 << 30, 100_000):
        memory = alignment.Memory(alignment.TOKENIZERS, most)
        for i in range(0, len(texts), 50):
            some = texts[i : i + 50]
            for side, (ids, first) in zip(memory.sides, memory.encode(some)):
                for t, a, b in zip(some, first, first[1:]):
                    whole = side.encode([t])[0]
                    fits = t and all(b"".join(s.tokens[k] for k in s.encode([t])[0]) == (" " + t).encode() for s in memory.sides)
                    assert ids[a:b].tolist() == (whole if fits else []), t
        assert memory.seams
