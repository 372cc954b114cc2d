"""Toxicity by a chain of classifiers.

The label columns are the links of the chain, in the order given. Each link is a linear model over the words of a text; a
later link also sees the earlier links' log-odds. For training these come from models that did not see the row
(out-of-fold), as they do when the chain is applied; the models applied are trained on all rows.

Models are fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their id. Features are words and beginnings of
words, the ``FEATURES`` that tell most about a label (information gain); each enters a model
with the size of its log-odds, so that a telling word costs little of the penalty on weights. The decision's
threshold is the one with the best F1 on out-of-fold predictions. Applying the chain is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import words as W
from veil.session import materialize

#: Labelled rows the chain is fitted on, at most; features for each label; folds.
SAMPLE, FEATURES, FOLDS = 20_000, 512, 4
PREFIX_BYTES = 6
CHAIN = ("quality", "toxic")
_MASK = np.uint64((1 << 18) - 1)


def _features(texts: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of the lower-cased texts; hashes of all words and of their first bytes, and the text each is in."""
    w = W.split(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), W.ALNUM)
    whole = w.hashes()
    begin = W.Words(w.data, w.starts, np.minimum(w.stops, w.starts + PREFIX_BYTES), w.first).hashes() ^ np.uint64(0x5555)
    owner = w.owner()
    return w, np.concatenate([whole, begin]), np.concatenate([owner, owner])


def _distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


@dataclass
class Lookup:
    """Sorted feature hashes, with a bit table of their low bits to pass over other words quickly."""

    known: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self.known & _MASK] = True

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, feature number), each once."""
        _, values, owner = _features(texts)
        at = np.flatnonzero(self.seen[values & _MASK])
        place = np.minimum(np.searchsorted(self.known, values[at]), max(len(self.known) - 1, 0))
        ok = self.known[place] == values[at] if len(self.known) else np.zeros(len(at), bool)
        return _distinct(owner[at][ok], place[ok])


@dataclass
class Link:
    name: str
    weights: np.ndarray  # of the features
    chain: np.ndarray  # of the earlier links' log-odds
    bias: float


@dataclass
class Chain:
    lookup: Lookup
    links: list[Link]
    threshold: float

    def log_odds(self, rows: int, owner: np.ndarray, feature: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for link in self.links:
            z = link.bias + np.bincount(owner, weights=link.weights[feature], minlength=rows) + sum(c * x for c, x in zip(link.chain, out))
            out.append(z)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(owner: np.ndarray, feature: np.ndarray, n_features: int, chain: np.ndarray, y: np.ndarray, size: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse features, each 0 or its ``size``, and a few dense ones, by accelerated gradient descent."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.zeros(n_features), np.zeros(chain.shape[1]), float(np.log(rate / (1 - rate)))
    scale = np.maximum(np.abs(chain).max(axis=0, initial=1.0), 1.0) if chain.size else np.ones(chain.shape[1])
    dense = chain / scale
    beta = np.zeros(n_features + dense.shape[1] + 1)
    ahead, t = beta.copy(), 1.0
    value = size[feature]
    rows = len(y)

    def product(b):
        return np.bincount(owner, weights=b[feature] * value, minlength=rows) + dense @ b[n_features:-1] + b[-1]

    def transposed(r):
        return np.concatenate([np.bincount(feature, weights=r[owner] * value, minlength=n_features), dense.T @ r, [r.sum()]])

    penalty = np.full(n_features + dense.shape[1] + 1, l2)
    penalty[-1] = 0
    # the largest curvature, by power iteration: steps of its inverse can't run away
    v = np.ones(len(penalty))
    for _ in range(30):
        v /= np.linalg.norm(v)
        u = transposed(product(v)) / rows
        top, v = float(np.linalg.norm(u)), u
    rate = 1 / (1.2 * 0.25 * top + l2)
    beta = np.zeros(len(penalty))
    ahead, t = beta.copy(), 1.0
    for _ in range(steps):
        g = transposed(sigmoid(product(ahead)) - y) / rows + penalty * ahead
        new = ahead - rate * g
        if g @ (new - beta) > 0:  # the momentum points uphill: start it anew
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - beta)
        beta, t = new, t_new
    return beta[:n_features] * size, beta[n_features:-1] / scale, float(beta[-1])


def labelled(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...], rows: int) -> DataFrame:
    """At most ``rows`` documents with all their labels, one row for each id. Conflicting labels: the larger counts.
    Of rows that repeat an id the text of smallest hash counts, null only if there is no other."""
    clean = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in chain])
    for c in chain:
        clean = clean.where(F.col(c).isin(0, 1))
    some = clean.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows).withColumnRenamed("doc_id", "l_id")
    found = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).drop("l_id")
    # tasks keep one row for each id before the shuffle
    one = found.groupBy("doc_id", *chain).agg(F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select("doc_id", "one.text", *chain)


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, rows: int = SAMPLE, features: int = FEATURES) -> Chain:
    """Fit the chain. Without labels, or with one value of a label only, a link gives the smoothed share of ones."""
    sample = materialize(labelled(docs, labels, chain, rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                _, values, owner = _features(part.column("text"))
                owner, values = _distinct(owner, values)
                if not len(values):
                    continue
                y = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in chain])[:, owner]
                hashes, at = np.unique(values, return_inverse=True)
                total = np.bincount(at)
                ones = [np.bincount(at, weights=y[i]).astype(np.int64) for i in range(len(chain))]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(total), *map(pa.array, ones)], ["f", "n", *[f"y{i}" for i in range(len(chain))]])

    ys = [f"y{i}" for i in range(len(chain))]
    counted = materialize(sample.mapInArrow(count, ", ".join(["f long", "n long", *[f"{y} long" for y in ys]])).groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).where("n >= 3"))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(y) for c, y in zip(chain, ys)]).first()
    chosen: dict[int, tuple] = {}
    for y in ys:
        with_, ones, rows = F.col("n"), F.lit(float(totals[y])), F.lit(float(totals["n"]))

        def term(part, row, column):
            return F.when(part > 0, part * F.log(part * rows / (row * column))).otherwise(0.0)

        gain = (
            term(F.col(y), with_, ones) + term(with_ - F.col(y), with_, rows - ones)
            + term(ones - F.col(y), rows - with_, ones) + term(rows - with_ - (ones - F.col(y)), rows - with_, rows - ones)
        )
        chosen |= {r["f"]: tuple(r) for r in counted.orderBy(gain.desc(), "f").limit(features).collect()}
    known = np.array(sorted(chosen), np.int64).view(np.uint64)
    lookup = Lookup(np.sort(known))
    stats = np.array([chosen[f] for f in lookup.known.view(np.int64).tolist()], float).reshape(-1, 2 + len(ys))

    def sizes(i: int) -> np.ndarray:
        n, one = stats[:, 1], stats[:, 2 + i]
        return np.abs(np.log((one + 0.5) / (n - one + 0.5) * (totals["n"] - totals[ys[i]] + 1.0) / (totals[ys[i]] + 1.0)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                owner, place = lookup.find(part.column("text"))
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                blobs = [place[s:e].astype(np.int32).tobytes() for s, e in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c).cast(pa.int32()) for c in chain], pa.array(blobs, pa.binary())], ["doc_id", *chain, "x"])

    table = sample.mapInArrow(encode, ", ".join(["doc_id long", *[f"`{c}` int" for c in chain], "x binary"])).toArrow().sort_by("doc_id")
    x = [np.frombuffer(b, np.int32) for b in table.column("x").to_pylist()]
    owner, feature = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate([*x, np.zeros(0, np.int32)])
    n_features = len(lookup.known)
    fold = (W.mix(table.column("doc_id").to_numpy().view(np.uint64)) % np.uint64(FOLDS)).astype(int) if len(x) else np.zeros(0, int)
    links: list[Link] = []
    held: list[np.ndarray] = []  # out-of-fold log-odds
    for i, name in enumerate(chain):
        size = sizes(i)
        y = table.column(name).to_numpy().astype(float)
        before = np.stack(held, axis=1) if held else np.zeros((len(x), 0))
        out = np.zeros(len(x))
        for k in range(FOLDS):
            inside, outside = fold != k, fold == k
            new = np.cumsum(inside) - 1
            own = inside[owner]
            w, c, b = fit_linear(new[owner[own]], feature[own], n_features, before[inside], y[inside], size)
            out[outside] = (b + np.bincount(owner, weights=w[feature], minlength=len(x)) + before @ c)[outside]
        held.append(out)
        links.append(Link(name, *fit_linear(owner, feature, n_features, before, y, size)))
    return Chain(lookup, links, _threshold(sigmoid(held[-1]), y))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, in the middle of the gap it lies in; above 1 if there is nothing to find."""
    if not y.sum():
        return 1.1
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    # a threshold can only stand between different values
    ends = np.append(p[order][1:] < p[order][:-1], True)
    i = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + below) / 2)


def judge(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<label> for each link, and ``rejected``: the last link's probability reaches the threshold.

    One row for each input row, in place. Null and empty texts have no words: they get the models' constant, and are not
    rejected. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(chain)
    names = [f"p_{link.name}" for link in chain.links]
    own = [c for c in docs.columns if c not in (*names, "rejected")]
    fields = docs.select(*own).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in W.slices(batch, text_col):
                owner, place = model.lookup.find(part.column(text_col))
                p = [sigmoid(z) for z in model.log_odds(part.num_rows, owner, place)]
                words = np.bincount(owner, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in own], *map(pa.array, p), pa.array((p[-1] >= model.threshold) & (words > 0))], [*own, *names, "rejected"]
                )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{n}` double" for n in names], "rejected boolean"])
    return docs.select(*own).mapInArrow(run, schema)
