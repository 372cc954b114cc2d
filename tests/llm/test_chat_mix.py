"""Chat formatting, mixing and the pipeline against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from veil.llm import chat, mixing

SCHEMA = "conv_id long, node long, parent long, score double, role string, text string, extra string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<||im_end|>", "<<|||", "<|im_end|>\n<|im_start|>user\nx", "", None, "|>", "plain\nlines\n", "<|", "😀 <|im_start|>"]


def trees():
    r = random.Random(4)
    rows = []
    for c in range(8):
        for n in range(r.randrange(1, 30)):
            parent = None if n == 0 else r.randrange(max(0, n - 4), n)
            rows.append((c if c else None, n, parent, float(r.randrange(5)), r.choice(["user", "assistant", "sys%tem", "a\nb<|"]), r.choice(TRICKY), "e"))
    rows += [(50, n, n - 1 if n else None, 0.0, "user", f"t{n}", "e") for n in range(70)]  # one long chain
    rows += [(51, 1, 2, 1.0, "user", "ring", "e"), (51, 2, 1, 1.0, "user", "ring", "e"), (52, 5, 99, None, None, None, "e"), (53, None, None, 1.0, "user", "no id", "e")]
    rows += [(54, 0, None, 1.0, "user", "b", "e"), (54, 0, None, 1.0, "user", "b", "e")]
    return rows


def best_paths(rows, best):
    out = {}
    by = {}
    for c, n, p, s, role, text, _ in rows:
        if n is not None:
            by.setdefault(c, {})[n] = (p, s or 0.0, role or "", text or "")
    for c, nodes in by.items():
        parents = {p for p, *_ in nodes.values()}
        ranked = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            ranked.append((-sum(nodes[x][1] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(ranked)[:best], 1):
            out[(c, rank)] = [(nodes[x][2], nodes[x][3]) for x in path]
    return out


@pytest.mark.parametrize("best", [1, 3])
def test_trees(spark, best):
    rows = trees()
    out = chat.format_trees(spark.createDataFrame(rows, SCHEMA).repartition(3), best)
    got = out.select("conv_id", "rank", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("lost")).collect()
    want = best_paths(rows, best)
    assert {(r.conv_id, r.rank): [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        turns = want[(r.conv_id, r.rank)]
        assert r.lost == [t for role, t in turns if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_trees_of_nothing(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", None), (1, 1, "assistant", "b"), (None, 0, "user", "n"), (2, None, "user", "x"), (2, 0, "user", "y")]
    out = chat.format_trees(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("user", ""), ("assistant", "c")], None: [("user", "n")], 2: [("user", "x"), ("user", "y")]}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, cut = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in cut]
        left = budget - sum(most * sizes[s] for s in cut)
        level = left / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in cut else level * weight[s] for s in names}
        cut |= more


@pytest.fixture(scope="module")
def mixed(make, prose):
    r = random.Random(2)
    docs = [(i, prose(i, r.randrange(1, 80)), "en", r.choice(["b", "a", "ä", "Z", None])) for i in range(400)]
    docs += [(1000 + i, prose(i, 30), "en", "hot") for i in range(300)] + [(2000, None, "en", "a"), (2001, "", "en", "empty"), (5, prose(9, 12), "en", "a"), (5, prose(9, 12), "en", "a"), (None, "x y", "en", "b")]
    return docs, mixing.mix_sources(make(docs)).collect()


def test_mixing(mixed):
    docs, got = mixed
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(docs)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.01 * t), s
    for s in sizes:  # each document has the whole copies at least
        if sizes[s]:
            assert all(r.copies >= int(want[s] / sizes[s] + 1e-9) for r in got if r.source == s)


def test_mixing_agrees_with_itself(make, mixed):
    docs, got = mixed
    again = mixing.mix_sources(make(docs, parts=7), keep=("path",)).select(*got[0].asDict()).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixing_draws_by_chance(make, prose):
    """Over many seeds each document is in the sample about as often as its chance says."""
    docs = make([(i, prose(i, 20 + i % 5), "en", "a") for i in range(60)] + [(100, prose(3, 3000), "en", "b")])
    slim = mixing.sizes(docs).where("source = 'a'").drop("draw").collect()
    n, times = {r.doc_id: 0 for r in slim}, 12
    for seed in range(times):
        for r in mixing.mix_sources(docs, weights=(1, 100, 1), share=0.5, seed=seed).where("source = 'a'").collect():
            n[r.doc_id] += r.copies
            share = r.target / r.source_size
    assert abs(sum(n.values()) / (times * len(n)) - share) < 0.05


@pytest.mark.parametrize("seed", range(4))
def test_mixing_with_a_very_long_document(make, prose, seed):
    """One document with a third of a source's words: the others fill the target whether it is drawn or not."""
    docs = make([(0, "w " * 6000, "en", "a"), *[(i, prose(i, 15 + i % 90), "en", "a") for i in range(1, 200)], (300, prose(3, 40_000), "en", "b")])
    got = mixing.mix_sources(docs, weights=(1, 3), share=0.5, seed=seed).where("source = 'a'").collect()
    target, taken = got[0].target, sum(r.taken for r in got)
    assert got[0].source_size < 3 * 6000 < 3 * target
    assert abs(target - taken) <= 50
    assert not any(r.copies == 0 and 0 < r.size < target - taken for r in got)


def test_mixing_nothing(make):
    assert mixing.mix_sources(make([])).collect() == []
    assert [r.taken for r in mixing.mix_sources(make([(1, ""), (2, None)])).collect()] == [0, 0]


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_queries_run(spark, name):
    """Each query gives a row for each document (or conversation) of the smallest tables."""
    folder = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, folder)
    if name.startswith("op6"):
        want = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        want = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got.count() == want


def test_chat_query(spark):
    from collections import defaultdict

    folder = "/root/testdata/sf0.001"
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    talks[-1] = [(0, "user", said), (1, "assistant", said)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in talks.items():
        turns.sort()
        lost = "".join(t for _, role, t in turns if role == "assistant")
        want[c] = (len(turns), digest("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(lost), digest(lost))
    got = entry.queries()["op6_chat"](spark, folder).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_pipeline_stages(spark):
    """Each stage keeps the columns, and its decisions hold in what it returns."""
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("rejected", F.lit("mine")).withColumn("base", F.lit(1))
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names, name
        before, docs = docs, spark.createDataFrame(out.collect(), docs.schema)
        assert docs.exceptAll(before).count() == 0 or name == "secret_scans"
        assert docs.count() <= before.count()
    assert 0.6 * whole < docs.count() < whole
    assert docs.where(F.col("text").rlike(r"(?i)(?:token|password) = \"?[0-9a-f]{24}|AKIA[A-Z0-9]{16}")).count() == 0
    assert docs.where("rejected <> 'mine' or base <> 1").count() == 0
    last = corpus_pipeline.mix(spark, docs, folder)
    assert last.where("copies < 1 or taken <> copies * size").count() == 0


def test_pipeline_on_nothing(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_run(spark):
    folder = "/root/testdata/sf0.001"
    got = entry.queries()["pipeline"](spark, folder)
    assert got.count() > 50 and got.where("copies > 2").count() == 0
