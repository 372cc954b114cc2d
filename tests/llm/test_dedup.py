"""Near duplicates and repeated passages against brute force."""

import hashlib
import re

import pytest

from veil.llm import graph, ngram_join, substrings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def grams(t, k=5):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(docs):
    """(class, links) of each row of (doc_id, text)."""
    sets = [grams(t) for _, t in docs]
    n = len(docs)
    link = [[bool(sets[i]) and i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for i in range(n):
        ids.setdefault(label[i], []).append(docs[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(least[label[i]], sum(link[i])) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(prose):
    docs = []
    for i in range(12):
        base = prose(i, 120)
        w = base.split(" ")
        docs.append((10 * i, base))
        if i % 2 == 0:
            docs.append((10 * i + 1, base.upper().replace("W", "w")))  # same words
            docs.append((10 * i + 2, " ".join(w[:60] + ["changed"] + w[61:])))
            docs.append((10 * i + 3, " ".join(w[:10] + ["other"] + w[11:])))
            docs.append((10 * i + 4, " ".join(w[:60]) + " " + prose(100 + i, 60)))  # half of it
    docs += [(500, ""), (501, None), (502, "one two three"), (503, "One two, three"), (504, "!!! ..."), (505, "one two three four")]
    docs += [(None, prose(0, 120)), (20, prose(77, 40)), (20, prose(77, 40)), (None, "one"), (None, None)]
    return docs


def test_near_duplicates(make, corpus):
    got = ngram_join.near_duplicates(make(corpus).select("doc_id", "text")).collect()
    want = near_brute(corpus)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == sorted(((d, *w) for (d, _), w in zip(corpus, want)), key=repr)


def test_near_duplicates_in_blocks(make, prose, monkeypatch):
    """Groups far larger than a block give the same links."""
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 4)
    w = prose(1, 150).split(" ")
    docs = [(i, " ".join(w[: 3 * i + 20] + [f"new{i}"] + w[3 * i + 21 :])) for i in range(40)]
    got = ngram_join.near_duplicates(make(docs).select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((d, *x) for (d, _), x in zip(docs, near_brute(docs)))


def test_bands_reach_the_recall():
    n, rows = ngram_join.bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** n >= 0.9999 and n * rows <= 128


def test_one_of_each(make, corpus):
    docs = make(corpus)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = near_brute(corpus)
    # the smallest id of each class, rows without words all, of a class without any id one
    firsts = {d for (d, t), (c, _) in zip(corpus, want) if d is not None and (d == c or not grams(t))}
    assert {r.doc_id for r in kept.collect()} - {None} == firsts
    assert kept.where("doc_id = 20").count() == 2  # two texts have this id, one of them twice


@pytest.mark.parametrize("m", [2279, 3001, 20_011])
def test_exact_ties_of_long_texts(m):
    """Sets that share 4m of 5m grams are linked, those that share one less are not."""
    import numpy as np
    import pyarrow as pa

    grams = np.arange(1, 5 * m + 1, dtype=np.uint64)
    blobs = [grams.tobytes(), grams[: 4 * m].tobytes(), grams[: 4 * m - 1].tobytes()]
    zero = pa.array([0, 0, 0], pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array([1, 2, 3]), pa.array([1, 1, 1]), pa.array(blobs, pa.binary())], ["grp", "lo", "hi", "side", "cls", "docs", "grams"])
    out = pa.Table.from_batches(ngram_join._verify(0.8)(iter([batch])))
    assert out.column("texts").to_pylist() == [1, 2, 1]


def test_near_duplicates_of_nothing(make):
    assert ngram_join.near_duplicates(make([]).select("doc_id", "text")).collect() == []
    assert ngram_join.one_of_each(make([])).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7), (-5, 3)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: -5 for i in [*range(201), -5]}, **{1000 + i: 1000 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def cut_brute(docs, k=13):
    words = [SPACED.findall(t or "") for _, t in docs]
    low = lambda d: (d is None, d or 0)
    first = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            first[t] = min(first.get(t, low(d)), low(d))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < low(d):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages(prose):
    shared = prose("p", 30, 50)
    docs = [(i, prose(i, 40, 30) + (f" {shared}\n" if i % 3 == 0 else "\t") + prose(i + 50, 30, 30)) for i in range(30)]
    docs += [(100 + i, "a b " * 20 + shared) for i in range(5)]  # repeats within a text
    docs += [(200, None), (201, ""), (202, "é ü " * 10), (203, "é ü " * 9), (None, shared), (None, "again " + shared), (7, shared), (7, shared), (300, docs[0][1])]
    return docs


@pytest.mark.parametrize("common", [None, 0.05])
def test_remove_repeats(make, passages, monkeypatch, common):
    """Also when a part of the minimisers counts as common."""
    if common:
        monkeypatch.setattr(substrings, "common_minimisers", lambda docs, window: real(docs, window, share=common))
    got = substrings.remove_repeats(make(passages).select("doc_id", "text")).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cut_brute(passages), key=repr)


real = substrings.common_minimisers


def test_remove_repeats_in_many_sendings(make, passages, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH_BYTES", 2000)
    got = substrings.remove_repeats(make(passages).select("doc_id", "text")).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(cut_brute(passages), key=repr)


def test_remove_repeats_of_nothing(make):
    assert substrings.remove_repeats(make([]).select("doc_id", "text")).collect() == []


def test_rows_that_share_an_id_and_a_short_hash_take_only_their_own_marks(spark):
    """Texts whose 32-bit hashes clash, under one id and under none; only one of each pair repeats a passage."""
    from pyspark.sql import functions as F

    from veil.llm import substrings

    passage = " ".join(f"p{i}" for i in range(20))
    own = F.expr("array_join(transform(sequence(0, 20), i -> concat('q', id, 'w', i)), ' ')")  # no window of another row
    made = spark.range(150_000).select(F.concat(F.lit(passage + " a"), "id").alias("x"), own.alias("y"))
    clash = made.select("x", F.hash("x").alias("h")).join(made.select("y", F.hash("y").alias("h")), "h").orderBy("x").limit(4).collect()
    assert clash
    rows = [(1, passage)]
    for i, r in enumerate(clash):
        rows += [(None, r["x"]), (None, r["y"])] if i % 2 else [(50 + i, r["x"]), (50 + i, r["y"])]
    got = {r["kept"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(passage) == 0
    assert all(got[r["y"]] == 0 for r in clash)
    assert sorted(n for k, n in got.items() if not k.startswith("q")) == [20] * len(clash)


def test_exact_copies_stay_within_the_stated_size():
    from veil.llm import substrings

    out, most = substrings._Sender(8), 0
    for doc in range(1_200_000):
        out.add(b"one passage", 3, doc, (doc, 0, 13, 5))
        if out.size > substrings.FLUSH_BYTES:
            most = max(most, len(out.marked) // 5)
            assert 1 < sum(b.num_rows for b in out.rows()) <= 2 + substrings.FLUSH_BYTES // substrings.MARK_BYTES // substrings.MARKS
    assert 0 < most <= substrings.FLUSH_BYTES // substrings.MARK_BYTES + 1


def test_stretch_hashes_do_not_depend_on_their_place():
    import numpy as np

    from veil.llm import words as W

    h = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    twice = np.concatenate([h[:7], h, h[5:]])
    a, b = np.array([0, 3, 10]), np.array([13, 4, 50])
    assert (W.stretch_hash(twice, a + 7, b + 7) == W.stretch_hash(h, a, b)).all()
    assert len(set(W.stretch_hash(h, np.arange(40), np.arange(40) + 10).tolist())) == 40


def test_marks_come_back_as_they_were_packed():
    import numpy as np

    from veil.llm import substrings

    r = np.random.default_rng(2)
    doc = np.sort(r.choice([-(2**62), -5, 0, 7, 2**63 - 1], 500))
    marks = np.stack([doc, r.integers(-(2**31), 2**31, 500), r.integers(0, 2**31 - 50, 500), np.zeros(500, np.int64), r.integers(0, 2**31, 500)], axis=1)
    marks[:, 3] = marks[:, 2] + r.integers(13, 50, 500)
    assert (substrings._unpacked_marks(substrings._packed_marks(marks)) == marks).all()
