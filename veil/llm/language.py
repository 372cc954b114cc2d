"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of the letters of its words: a letter's probability given the ``ORDER`` - 1 characters before it in
the word, beginnings and ends included. Counts are gathered from all training texts: tasks count runs of ``ORDER`` characters,
which are added up for each language. Lower orders follow from these: the continuation count of a shorter run is the number of
different characters before it.

A run is a number, 12 bits for each character (others than the first 4095 letters of Unicode share codes), so the model is a
sorted array of numbers for each order, searched by bisection. The runs of all languages are scored once for all languages; runs
that no training text had are scored where they occur. A text gets the language of lowest cross-entropy, the bits of its
letters divided by their number. It is accepted if that is no more than nearly all calibration texts of the language have.

No run is left out. The arrays sent to the tasks hold at most ``MOST_RUNS`` runs: with no more in all, the models are such
arrays (``Model``). With more, the models stay tables (``Tables``): orders, continuation counts and discounts are derived from all
counted runs by groupings, the runs that the texts to be judged have are scored by joins, order by order, the scores of the most
frequent ``MOST_RUNS`` of them are sent to the tasks, and the other runs of each text meet theirs in a shuffled join. Both ways
give the same bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import words as W
from veil.session import materialize, small

ORDER, BITS = 5, 12
MOST_RUNS = 4_000_000
#: Runs a task holds before it sends their counts.
HELD = 2_000_000
#: Contexts of one order that may be broadcast; a row has some 20 bytes for each language.
FEW_CONTEXTS = 200_000
#: Share of a language's calibration texts that its limit accepts, and the bits a letter by which the limit is loosened.
ACCEPTED, SLACK = 0.995, 0.1
#: Letters from which on more evidence doesn't raise the score.
ENOUGH = 40
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each letter and each end of a word, as a number, and the text it is in."""
    lower = [t.lower() for t in pc.fill_null(texts.cast(pa.large_string()), "").to_pylist()]
    code = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(t) for t in lower]) + 1
    size[-1] -= 1
    owner = np.repeat(np.arange(len(lower)), size)
    c = np.where(_letters()[code], 1 + code.astype(np.int64) % ((1 << BITS) - 1), 0)
    # borders between words count once, as the end of the word before
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    c, owner = c[keep], owner[keep]
    if len(c) and c[-1] > 0:
        c, owner = np.append(c, 0), np.append(owner, owner[-1])
    # the border after a text's last word may belong to the space put between texts
    key, before = c.copy(), c
    for i in range(1, ORDER):
        before = np.concatenate([np.zeros(1, np.int64), before[:-1]])
        if i > 1:
            before[previous == 0] = 0  # nothing from before the word
        previous = before.copy()
        key |= before << (BITS * i)
    return key, owner


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "run", "n"])
        held.clear()

    for batch in batches:
        for rows in W.slices(batch, "text"):
            langs = rows.column("lang").dictionary_encode()
            key, owner = runs(rows.column("text"))
            which = langs.indices.to_numpy()[owner]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                keys, n = np.unique(key[which == i], return_counts=True)
                if len(keys):
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


class Model:
    """Kneser-Ney models of some languages as sorted arrays."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.levels = [self._levels(*counts[x]) for x in langs]
        self.symbols = max((len(lv[0][0]) for lv in self.levels), default=1) + 1
        every = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, np.int64)
        self.known, self.scores = every, self.bits(every)
        self.limits = np.full(len(langs), np.inf)

    @staticmethod
    def _levels(run: np.ndarray, n: np.ndarray) -> list[tuple]:
        """For each order: sorted runs, counts, sorted contexts, their totals and numbers of followers, and the discount."""
        out = []
        for order in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones + twos else 0.5
            context, at = np.unique(run >> BITS, return_inverse=True)
            out.append((run, n, context, np.bincount(at, weights=n, minlength=len(context)), np.bincount(at, minlength=len(context)), discount))
            if order > 1:
                run, n = np.unique(run & ((1 << BITS * (order - 1)) - 1), return_counts=True)
        return out[::-1]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each run's last character in each language."""
        out = np.empty((len(keys), len(self.langs)), np.float32)
        for i, levels in enumerate(self.levels):
            p = np.full(len(keys), 1.0 / self.symbols)
            for order, (run, n, context, total, followers, discount) in enumerate(levels, 1):
                if not len(run):
                    continue
                suffix = keys & ((1 << BITS * order) - 1)
                at = np.minimum(np.searchsorted(context, suffix >> BITS), len(context) - 1)
                there = context[at] == suffix >> BITS
                spot = np.minimum(np.searchsorted(run, suffix), len(run) - 1)
                own = np.where(run[spot] == suffix, np.maximum(n[spot] - discount, 0.0), 0.0)
                p = np.where(there, (own + discount * followers[at] * p) / total[at], p)
            out[:, i] = -np.log2(p)
        return out

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and its number of letters (with ends of words)."""
        key, owner = runs(texts)
        keys, at = np.unique(key, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        seen = self.known[spot] == keys if len(self.known) else np.zeros(len(keys), bool)
        scores = np.empty((len(keys), len(self.langs)), np.float32)
        scores[seen] = self.scores[spot[seen]]
        scores[~seen] = self.bits(keys[~seen])
        n = np.bincount(owner, minlength=len(texts))
        total = np.stack([np.bincount(owner, weights=scores[at, i], minlength=len(texts)) for i in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(texts), 0))
        return total / np.maximum(n, 1)[:, None], n


class Tables:
    """The same models as tables of all runs, for more runs than arrays should hold; ``wide[o]`` has the counts of order o + 1,
    one column for each language, null where a language doesn't have the run."""

    #: Runs held in arrays: none.
    levels: tuple = ()

    def __init__(self, counted: DataFrame, most: int):
        self.most = most
        self.langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
        each = range(len(self.langs))
        table = materialize(counted.groupBy("run").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(self.langs)]))
        wide = [table]
        for order in range(ORDER - 1, 0, -1):
            run = F.col("run").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("run")
            table = materialize(table.groupBy(run).agg(*[F.nullif(F.count(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in each]))
            wide.append(table)
        self.wide = wide[::-1]
        self.discounts = []
        for table in self.wide:
            r = table.agg(*[F.count_if(F.col(f"n{i}") == k).alias(f"c{i}_{k}") for i in each for k in (1, 2)]).first()
            pairs = [(r[f"c{i}_1"], r[f"c{i}_2"]) for i in each]
            self.discounts.append([float(np.clip(a / (a + 2 * b), 0.1, 0.9)) if a + b else 0.5 for a, b in pairs])
        self.symbols = max(self.wide[0].agg(*[F.count(f"n{i}").alias(f"n{i}") for i in each]).first()) + 1
        self.limits = np.full(len(self.langs), np.inf)

    def bits(self, keys: DataFrame) -> DataFrame:
        """``keys`` (run: each once) with b0, b1, ...: bits of the run's last character in each language.

        The probabilities of an order are computed once for each different end of the runs. A key of a join has at most as many
        rows as there are characters.
        """
        each = range(len(self.langs))
        p = None
        for order, (table, discount) in enumerate(zip(self.wide, self.discounts), 1):
            ends = keys.select(F.col("run").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("run")).distinct()
            if p is None:
                ends = ends.select("run", *[F.lit(1.0 / self.symbols).alias(f"p{i}") for i in each])
            else:
                shorter = F.col("run").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
                ends = ends.withColumn("end", shorter).join(p.withColumnRenamed("run", "end"), "end").drop("end")
            contexts = table.groupBy(F.shiftright("run", BITS).alias("context")).agg(
                *[F.sum(f"n{i}").alias(f"t{i}") for i in each], *[F.count(f"n{i}").alias(f"f{i}") for i in each]
            )
            # the few contexts of the lower orders have many rows each
            contexts = small(contexts, FEW_CONTEXTS)
            rows = ends.withColumn("context", F.shiftright("run", BITS)).join(contexts, "context", "left").join(table, "run", "left")

            def step(i, d):
                own = F.greatest(F.coalesce(F.col(f"n{i}"), F.lit(0)) - F.lit(d), F.lit(0.0))
                return F.when(F.col(f"t{i}").isNull(), F.col(f"p{i}")).otherwise((own + F.lit(d) * F.col(f"f{i}") * F.col(f"p{i}")) / F.col(f"t{i}"))

            p = materialize(rows.select("run", *[step(i, d).alias(f"p{i}") for i, d in enumerate(discount)]))
        return p.select("run", *[(-F.log2(f"p{i}")).cast("float").alias(f"b{i}") for i in each])


def train(docs: DataFrame, most: int = MOST_RUNS) -> Model | Tables:
    """Models of all languages of ``docs`` (text, lang); rows without either teach nothing. At most ``most`` runs are held in
    arrays; more stay in tables."""
    counted = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_count, "lang string, run long, n long")
    counted = materialize(counted.groupBy("lang", "run").agg(F.sum("n").alias("n")))
    if counted.count() > most:
        return Tables(counted, most)
    table = counted.toArrow().combine_chunks()
    lang, run, n = (table.column(c) for c in ("lang", "run", "n"))
    counts = {}
    for name in sorted(pc.unique(lang).to_pylist()):
        mine = pc.equal(lang, name)
        keys, k = run.filter(mine).to_numpy(), n.filter(mine).to_numpy()
        order = np.argsort(keys)
        counts[name] = (keys[order], k[order])
    return Model(list(counts), counts)


def _identify(docs: DataFrame, model: Tables, text_col: str) -> DataFrame:
    """``identify`` with tables. Rows find their sums by the text's hashes."""
    names = ["lang_pred", "score", "bits", "accepted"]
    own = [c for c in docs.columns if c not in names]
    each = range(len(model.langs))
    text = F.col(f"`{text_col}`").cast("string")
    hashes = [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]
    texts = docs.select(*hashes, text.alias("text"))
    counted = texts.where("text is not null").select(F.lit("").alias("lang"), "text").mapInArrow(_count, "lang string, run long, n long")
    counted = materialize(counted.groupBy("run").agg(F.sum("n").alias("n")))
    scored = materialize(model.bits(counted.select("run")).join(counted, "run"))
    often = scored.orderBy(F.col("n").desc(), "run").limit(model.most).drop("n").toArrow().combine_chunks().sort_by("run")
    known = often.column("run").to_numpy()
    scores = np.stack([often.column(f"b{i}").to_numpy() for i in each], axis=1)
    sent = docs.sparkSession.sparkContext.broadcast((known, scores))
    sums = [f"s{i}" for i in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = sent.value
        for batch in batches:
            for rows in W.slices(batch, "text"):
                key, owner = runs(rows.column("text"))
                spot = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                here = known[spot] == key if len(known) else np.zeros(len(key), bool)
                at = owner[here]
                k1, k2 = rows.column("_k1"), rows.column("_k2")
                # a row for each text with the sums of the frequent runs, then one for each other run of each text
                yield pa.RecordBatch.from_arrays(
                    [
                        k1, k2, pa.nulls(rows.num_rows, pa.int64()), pa.array(np.bincount(at, minlength=rows.num_rows)),
                        *[pa.array(np.bincount(at, weights=scores[spot[here], i], minlength=rows.num_rows).astype(np.float64)) for i in each],
                    ],
                    ["_k1", "_k2", "run", "n", *sums],
                )
                order = np.lexsort((key[~here], owner[~here]))
                key, owner = key[~here][order], owner[~here][order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))) if len(key) else np.zeros(0, int)
                which = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays(
                    [k1.take(which), k2.take(which), pa.array(key[new]), pa.array(np.diff(np.append(new, len(key)))), *[pa.nulls(len(new), pa.float64()) for _ in each]],
                    ["_k1", "_k2", "run", "n", *sums],
                )

    found = materialize(texts.mapInArrow(run, ", ".join(["_k1 long, _k2 long, run long, n long", *[f"{c} double" for c in sums]])))
    rare = found.where("run is not null").drop(*sums).join(scored.drop("n"), "run")
    rare = rare.select("_k1", "_k2", "run", "n", *[(F.col("n") * F.col(f"b{i}").cast("double")).alias(f"s{i}") for i in each])
    total = found.where("run is null").unionByName(rare).groupBy("_k1", "_k2").agg(
        F.count_if(F.col("run").isNull()).alias("_rows"), F.sum("n").alias("_all"), F.array(*[F.sum(c) for c in sums]).alias("_bits")
    )
    # equal texts were added up together
    total = total.select("_k1", "_k2", (F.col("_all") / F.col("_rows")).alias("_n"), F.transform("_bits", lambda x: x / F.greatest(F.col("_all"), F.lit(1))).alias("_h"))
    low, ok = F.array_min("_h"), F.col("_n") > 0
    best = F.array_position("_h", low).cast("int")
    share = F.aggregate("_h", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), -(x - low) * F.least("_n", F.lit(float(ENOUGH)))))
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limits]), best)
    judged = total.select(
        "_k1", "_k2", F.when(ok, F.element_at(F.array(*[F.lit(x) for x in model.langs]), best)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(ok, 1 / F.greatest(share, F.lit(1.0))).otherwise(0.0).alias("score"), F.when(ok, low).alias("bits"), (ok & (low <= limit)).alias("accepted"),
    )
    return docs.select(*own, *hashes).join(judged, ["_k1", "_k2"]).select(*own, *names)


def identify(docs: DataFrame, model: Model | Tables, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), bits (cross-entropy, bits a letter) and ``accepted`` (calibrated rejection).

    One row for each input row, in place. Null texts and texts without letters are ``und`` with score 0, not accepted; so is
    every text if no language was learnt. Ties go to the first language by code point. Columns of these names are replaced.
    """
    if isinstance(model, Tables):
        return _identify(docs, model, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "bits", "accepted"]
    own = [c for c in docs.columns if c not in names]
    fields = docs.select(*own).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for rows in W.slices(batch, text_col):
                h, n = m.judge(rows.column(text_col))
                ok = (n > 0) & (len(m.langs) > 0)
                best = h.argmin(axis=1) if len(m.langs) else np.zeros(rows.num_rows, int)
                low = h[np.arange(len(best)), best] if len(m.langs) else np.zeros(rows.num_rows)
                # share of the best language if each had the evidence of so many letters
                share = 1 / np.maximum(np.exp2(-(h - low[:, None]) * np.minimum(n, ENOUGH)[:, None]).sum(axis=1), 1.0)
                label = np.where(ok, np.array([*m.langs, UNKNOWN], object)[np.where(ok, best, -1)], UNKNOWN)
                limit = m.limits[best] if len(m.langs) else np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in own], pa.array(label.tolist(), pa.string()), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, low, np.nan), mask=~ok), pa.array(ok & (low <= limit))],
                    [*own, *names],
                )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "lang_pred string, score double, bits double, accepted boolean"])
    return docs.select(*own).mapInArrow(run, schema)


def calibrate(model: Model | Tables, docs: DataFrame, accepted: float = ACCEPTED) -> Model | Tables:
    """Set each language's limit so that it accepts the given share of ``docs`` (text, lang) of that language."""
    judged = identify(docs.where("text is not null and lang is not null").select("lang", "text"), model)
    rows = judged.where("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("bits", accepted, 1000).alias("q")).collect()
    limits = {r["lang"]: r["q"] + SLACK for r in rows}
    model.limits = np.array([limits.get(x, np.inf) for x in model.langs])
    return model
