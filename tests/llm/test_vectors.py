"""Near-duplicate vectors against all cosines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import vectors


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(links[i]), low, key == low))
    return sorted(out, key=repr)


def result(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3).withColumns({"label": F.lit(1), "vec": F.lit("x"), "cls": F.lit(2)})
    return sorted((tuple(r) for r in vectors.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def some_vectors(seed, n, dims, noise):
    """Groups, chains of near vectors, copies and lone vectors, as single-precision numbers."""
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        at = r.standard_normal(dims)
        for _ in range(int(r.integers(1, 9))):
            at = at + noise * r.standard_normal(dims)
            out += [at.astype(np.float32).tolist()] * int(r.integers(1, 3))
    return [(i, v) for i, v in enumerate(out[:n])]


def test_all_links(spark):
    rows = some_vectors(1, 400, 24, 0.2)
    rows = [(900 - i, v) for i, v in rows]
    got = result(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 300 and len({r[2] for r in got}) > 50


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(5)
    middle = r.standard_normal(32)
    rows = [(i, (middle + 0.12 * r.standard_normal(32)).tolist()) for i in range(150)] + [(1000 + i, r.standard_normal(32).tolist()) for i in range(80)]
    assert result(spark, rows, "double") == brute(rows)


def test_unusable_vectors_and_ids(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (None, a), (None, b), (7, a), (7, a), (9, None), (10, []), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 3.0]), (13, [1.0, float("nan"), 3.0]), (14, [float("inf"), 2.0, 3.0]),
        (15, [*a, 0.0]), (None, [-5.0, 1.0, 0.0]), (16, [2.0, 4.0, 6.0]), (17, [-1.0, -2.0, -3.0]), (None, None), (18, [1e200, 2e200, 3e200]),
    ]
    assert result(spark, [r for r in rows if r[0] != 18], "double") == brute([r for r in rows if r[0] != 18])
    large = dict((r[0], r) for r in result(spark, rows, "double"))
    assert large[18][1:3] == (5, 7)


def test_long_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal(100_000)
    rows = [(1, base.tolist()), (2, (base + 0.1 * r.standard_normal(100_000)).tolist()), (3, r.standard_normal(100_000).tolist())]
    assert [x[1] for x in result(spark, rows, "double")] == [1, 1, 0]


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("n", [1, 10**4, 10**7, 10**10])
def test_tables_reach_the_recall(n):
    n_tables, bits = vectors.tables(n)
    assert 1 - (1 - vectors.agreement(0.95) ** bits) ** n_tables >= 0.9999
    assert n_tables < 1 << 12
