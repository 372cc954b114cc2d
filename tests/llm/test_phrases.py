"""Collocations against counting in plain Python, and automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import phrases
from veil.llm.automata import Automaton, Union, sort_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, report):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        many = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inside = defaultdict(int)
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in many.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:report], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4).withColumns({"doc_id": F.lit(1), "page": F.lit("x"), "word": F.lit(0)})
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def corpus(seed, n, words=25):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["É", "ß", "東京", "a\x01", "a", "x y"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(30)):
            text += r.choice(names[: r.choice([3, 8, 40])]) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", and ", " New York City "])
        out.append((text, r.choice(["en", "en", "fr", None, ""])))
    return out


@pytest.mark.parametrize("options", [{}, {"page_bytes": 2000}, {"report": 5, "page_bytes": 500}])
def test_by_brute_force(spark, options):
    rows = corpus(3, 400)
    settings = {"least": 4, "report": 2000, **options}
    got = result(spark, rows, **settings)
    assert got == brute(rows, settings["least"], settings["report"])
    assert len(got) >= 20


def test_one_phrase_in_most_rows(spark):
    rows = [("the same old story again and again and again " * 3, "en")] * 300 + corpus(5, 60)
    assert result(spark, rows, least=20, page_bytes=3000) == brute(rows, 20, 2000)


def test_nulls_long_texts_and_repeats(spark):
    rows = [(None, "en"), ("", None), ("...", "en"), ("one two three " * 50_000, "en"), ("a b", None), ("a b", None), ("z" * 200_000 + " q " + "z" * 200_000, "de")]
    assert result(spark, rows, least=2) == brute(rows, 2, 2000)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits, which no corpus of a test could have."""
    a, n, l, r = 999_999_999_937, 10**16 + 7, 10**12 + 1, 10**13 + 3
    df = spark.createDataFrame([(a, n, [l], [r])], "a long, n long, ls array<long>, rs array<long>")
    assert df.select(phrases.best_cut()["score"]).first()[0] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("total", [True, False])
def test_automata(total):
    r = np.random.default_rng(0)
    for _ in range(60):
        sums, union = Counter(), Union(5, most=20)
        for _ in range(4):
            n = int(r.integers(0, 40))
            rows = r.integers(0, 3, (n, 5))
            for x in rows:
                x[int(r.integers(1, 6)) :] = -1
            rows, w = sort_rows(rows, r.integers(1, 3, n))
            own = Counter()
            for x, c in zip(rows.tolist(), w.tolist()):
                x = tuple(v for v in x if v >= 0)
                for d in range(1, len(x) + 1):
                    own[x[:d]] += c if total or d == len(x) else 0
            one = Automaton.load(Automaton.build(rows, w, total).dump())
            assert {tuple(p): c for ps, cs in one.paths() for p, c in zip(ps.tolist(), cs.tolist())} == own
            asked = r.integers(0, 4, (30, 5))
            for x in asked:
                x[int(r.integers(1, 6)) :] = -1
            assert one.weights_of(asked).tolist() == [own[tuple(v for v in x if v >= 0)] for x in asked.tolist()]
            sums.update(own)
            union.add(one)
        assert {tuple(p): c for d in range(5) for p, c in zip(*(x.tolist() for x in union.sums(d)))} == sums


def test_equal_continuations_are_stored_once():
    rows = np.array([[a, b, c, 7, 8] for a in range(50) for b in range(3) for c in range(2)])
    made = Automaton.build(rows, np.ones(len(rows), np.int64))
    assert [len(level.label) for level in made.levels] == [50, 3, 2, 1, 1]
