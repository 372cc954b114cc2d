"""Mixing sources to target weights by Pareto order sampling.

A source of ``source_size`` words gets ``target`` words. The whole part of their ratio is certain: each
document is copied that often. The rest is a sample without replacement: each document draws a uniform
number from a hash of its id and text, its rank is the odds of the draw divided by the odds of its inclusion
probability, and the documents of lowest rank are taken. The sample size is fixed in words: documents are taken
in rank order while they fit the rest of the target. If a long one does not, further rounds go on down the ranks with the
documents of at most half the gap; each round halves it or takes all of these. One more document, the one that fits best,
closes what gap they leave, so that no document left out is smaller than the gap.

The place is found without sorting a source in one task: ranks are counted into ``BINS`` bins for each
source (pre-aggregated before the shuffle), running totals over these few rows find the bin in which the
target is reached, and only this bin's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.session import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 16
#: Sources whose figures may be broadcast; a row has under 100 bytes. Beyond it the join is a shuffled one.
FEW_SOURCES = 50_000
#: Documents that fill gaps, of all sources, that may be broadcast.
FEW_PICKS = 500_000


def spread_budget(sources: DataFrame, budget: float, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares of ``budget`` by weight, none above ``most``
    times its source's size, what is cut off shared again by weight until nothing is.

    Each round is one aggregate over the sources, with one row as its result; a round fixes one source at least.
    """
    limit = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        # a source is cut if it would get more than its limit at this level; the level only rises
        cut = F.col("weight") * F.lit(level) >= limit
        row = sources.agg(
            F.sum(F.when(cut, limit).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(cut, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        higher = max(0.0, (budget - row["fixed"]) / row["open"])
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit) if level else F.lit(0.0))


def cycle_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` with ``weight``: the given weights in turn, by code point order of the source, null last.

    One row for each source is ordered here, not one for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """doc_id, source, size in words, and the document's uniform draw; plus the columns named in ``keep``."""
    draw = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # 52 bits, moved off 0 and 1
        ((F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("draw"),
        *[F.col(c) for c in keep if c not in ("doc_id", "source", "size", "draw")],
    )


def _rank(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their source's figures, whole copies, and the rank of the draw for the rest, with its bin."""
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sized.join(small(targets, FEW_SOURCES), F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("whole", F.floor(ratio + 1e-9).cast("long"))
        .withColumn("chance", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
        .withColumn("odds", F.when(F.col("chance") > 0, F.col("draw") / (1 - F.col("draw")) * (1 - F.col("chance")) / F.col("chance")))
        .withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * BINS).cast("int"))
        .drop("t_source")
    )


def _edges(ranked: DataFrame) -> DataFrame:
    """For each source the bin in which the rest of its target is reached, and the words before it."""
    bins = ranked.where("bin is not null").groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.first(F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bins.withColumn("so_far", F.sum("words").over(upto))
        .where("so_far >= rest and so_far - words < rest")
        .select(F.col("source").alias("e_source"), F.col("bin").alias("edge"), (F.col("so_far") - F.col("words")).alias("before"), "rest")
    )


def _sample(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """``ranked`` with ``extra``: 1 for the documents in rank order whose words stay within the rest of the target."""
    placed = ranked.join(small(edges, FEW_SOURCES), F.col("source").eqNullSafe(F.col("e_source")), "left")
    at_edge = F.coalesce(F.col("bin") == F.col("edge"), F.lit(False))
    upto = Window.partitionBy("source").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = placed.where(~at_edge).withColumn("extra", F.coalesce(F.col("bin") < F.col("edge"), F.col("chance") > 0).cast("long"))
    edge = placed.where(at_edge).withColumn("upto", F.sum("size").over(upto))
    return rest.unionByName(edge.withColumn("extra", (F.col("before") + F.col("upto") <= F.col("rest")).cast("long")).drop("upto")).drop("e_source")


def _fill(sampled: DataFrame) -> DataFrame:
    """The documents left out that fill what their source's sample leaves of the target: c_source, last_id, last_odds.

    Rows that agree in id and text come in together.
    """
    source = lambda c: F.col("source").eqNullSafe(F.col(c))
    gaps = sampled.where("edge is not null").groupBy("source").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    gaps = materialize(gaps.withColumnRenamed("source", "g_source"))
    left = sampled.where("edge is not null and extra = 0 and size > 0").select("source", "doc_id", "odds", "bin", "size")
    left = left.groupBy("source", "doc_id", "odds").agg(F.sum("size").alias("size"), F.first("bin").alias("bin"))
    near = lambda rows: rows.join(small(gaps, FEW_SOURCES), source("g_source")).where("size < 2 * gap").drop("g_source")
    left = materialize(near(left))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_odds = Window.partitionBy("source").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picks = []
    while not left.where("2 * size <= gap").isEmpty():
        fits = 2 * F.col("size") <= F.col("gap")
        bins = left.where(fits).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        edges = bins.withColumn("so_far", F.sum("words").over(by_bin)).where("so_far > gap and so_far - words <= gap")
        edges = edges.select(F.col("source").alias("e_source"), F.col("bin").alias("edge"), (F.col("so_far") - F.col("words")).alias("before"))
        placed = left.join(small(materialize(edges), FEW_SOURCES), source("e_source"), "left").withColumn("fits", fits)
        at_edge = F.coalesce(F.col("fits") & (F.col("bin") == F.col("edge")), F.lit(False))
        rest = placed.where(~at_edge).withColumn("taken", F.col("fits") & F.coalesce(F.col("bin") < F.col("edge"), F.lit(True)))
        edge = placed.where(at_edge).withColumn("taken", F.col("before") + F.sum("size").over(by_odds) <= F.col("gap"))
        round_ = materialize(rest.unionByName(edge).select("source", "doc_id", "odds", "bin", "size", "taken"))
        picks.append(round_.where("taken").select("source", "doc_id", "odds"))
        used = round_.where("taken").groupBy("source").agg(F.sum("size").alias("used"))
        used = small(used.withColumnRenamed("source", "u_source"), FEW_SOURCES)
        gaps = materialize(gaps.join(used, F.col("g_source").eqNullSafe(F.col("u_source")), "left").select("g_source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
        left = materialize(near(round_.where("not taken").drop("taken")))
    best = F.min_by(F.struct("doc_id", "odds"), F.struct(F.abs(F.col("size") - F.col("gap")), "odds", "doc_id"))
    picked = left.groupBy("source").agg(best.alias("last")).select("source", "last.doc_id", "last.odds")
    for rows in picks:
        picked = picked.unionByName(rows)
    return picked.select(F.col("source").alias("c_source"), F.col("doc_id").alias("last_id"), F.col("odds").alias("last_odds"))


def mix(sized: DataFrame, targets: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """Each row of ``sized`` (see ``sizes``) with source_size, target, ``copies`` and ``taken`` (words of all copies).

    ``targets``: source, source_size, target. ``slim``: the same rows without further columns, already written.
    Null is a source like any other. Rows that agree in id and text draw the same number and stand next to each other
    in the ranking. A source without words gives nothing. An empty table gives an empty result.
    """
    slim = _rank(sized if slim is None else slim, targets)
    edges = materialize(_edges(slim))
    closers = small(materialize(_fill(_sample(slim, edges))), FEW_PICKS)
    done = _sample(_rank(sized, targets), edges).join(
        closers, F.col("source").eqNullSafe(F.col("c_source")) & F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("odds") == F.col("last_odds")), "left"
    )
    copies = F.col("whole") + F.greatest(F.col("extra"), F.col("last_odds").isNotNull().cast("long"))
    return done.select(*[c for c in sized.columns if c != "draw"], "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, keep: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """Mix a whole table: ``share`` times its words, spread over the sources by ``weights`` in turn.

    Returns doc_id, source, size, source_size, target, copies, taken and the columns of ``keep``, one row for each
    input row. A null text has no words; a null id or source is a value like any other.
    """
    slim = materialize(sizes(docs, seed=seed, **columns))
    sources = materialize(cycle_weights(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = spread_budget(sources, share * budget, most)
    return mix(sizes(docs, seed=seed, keep=keep, **columns), targets, slim) if keep else mix(slim, targets)
