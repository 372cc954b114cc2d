"""Tokens: one stable name per session, type and value; writing them into texts and back out again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.text import norm
from veil.operators.resolve import TYPE_PRECEDENCE
from veil.operators.spans import Rule, find_spans
from veil.session import light, materialize

SITES_PER_TOKEN, SITE_CONTEXT, SITE_MIN_MATCH = 32, 40, 10


def assign_tokens(findings: DataFrame, session: str = "session_id", order: str = "doc_id", config: Config | None = None) -> DataFrame:
    """Token map: ``session, type, norm, ordinal, token, canonical``, numbered in first-seen order.

    Numbers run per session and type, in the order of the texts' ids, of whatever type these are. A session may be the whole
    corpus, so no task ever sorts all of its values: distinct values are spread by ranges of (session, type, place) and
    written once; they are numbered within a range, and the ranges' sizes, one row each, give every range its first number.
    """
    config = config or Config()
    position = F.struct(F.col(order).alias("o"), F.col("start_at").alias("s"))
    first = (
        findings.withColumn("norm", norm(F.col("value")))
        .groupBy(session, "type", "norm")
        .agg(F.min(position).alias("_pos"), F.min_by("value", position).alias("canonical"))
    )
    ranged = first.repartitionByRange(session, "type", "_pos", "norm")
    first = materialize(ranged.withColumn("_bucket", F.spark_partition_id()))
    sizes = first.groupBy(session, "type", "_bucket").count()
    earlier = Window.partitionBy(session, "type").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(session, "type", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(session, "type", "_bucket").orderBy("_pos", "norm")
    numbered = first.withColumn("_n", F.row_number().over(inside)).join(bases, [session, "type", "_bucket"])
    ordinal = (F.col("_base") + F.col("_n")).cast("bigint")
    return numbered.select(
        session, "type", "norm", ordinal.alias("ordinal"),
        F.concat(F.lit(config.token_prefix), "type", F.lit("_"), ordinal.cast("string"), F.lit(config.token_suffix)).alias("token"),
        "canonical",
    )


def attach_tokens(findings: DataFrame, token_map: DataFrame, session: str = "session_id") -> DataFrame:
    """Findings with their token."""
    names = token_map.select(session, "type", F.col("norm").alias("_norm"), "token")
    return findings.withColumn("_norm", norm(F.col("value"))).join(names, [session, "type", "_norm"]).drop("_norm")


def splice(text: Column, edits: Column) -> Column:
    """Replace non-overlapping, sorted ``{start_at, end_at, token}`` ranges of a text."""

    def piece(e, i):
        last = F.when(i > 0, F.get(edits, i - 1)["end_at"]).otherwise(0)
        return F.concat(F.substring(text, last + 1, e["start_at"] - last), e["token"])

    tail = F.substring(text, F.element_at(edits, -1)["end_at"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(edits, piece), ""), tail)


def redact(texts: DataFrame, tokenised: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every text with ``redacted`` beside it; texts without findings come through as they are.

    ``tokenised`` is read twice. While the edits are few they go to the texts, which then stay where they are.
    """
    edits = tokenised.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "token"))).alias("_edits"))
    joined = texts.join(light(edits), keys, "left")
    return joined.withColumn(
        "redacted", F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))
    ).drop("_edits")


def redact_spans(texts: DataFrame, tokenised: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Redacted text plus what was replaced where, as an array."""
    span = F.struct("start_at", "end_at", "token", F.col("value").alias("original"), "type", "finding_id", "level", "confidence", "reason")
    edits = tokenised.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    joined = texts.join(edits, keys, "left")
    masked = F.when(F.col("spans").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("spans")))
    return joined.withColumn("redacted", masked)


def changed_only(redacted: DataFrame, text: str = "text") -> DataFrame:
    return redacted.where(~F.col(text).eqNullSafe(F.col("redacted")))


def token_sites(tokenised: DataFrame, session: str = "session_id", order: str = "doc_id", most: int | None = SITES_PER_TOKEN) -> DataFrame:
    """The first ``most`` distinct places each token stands for (None: all): surface and 40 characters either side.

    Duplicates collapse before the shuffle, and the rank filter is applied on both sides of it, so a
    token that occurs everywhere sends at most so many rows per task.
    """
    position = F.struct(F.col(order).alias("o"), F.col("start_at").alias("s"))
    places = (
        tokenised.select(
            session, "token", "surface", F.right("before", F.lit(SITE_CONTEXT)).alias("before"),
            F.left("after", F.lit(SITE_CONTEXT)).alias("after"), position.alias("_pos"),
        )
        .groupBy(session, "token", "surface", "before", "after")
        .agg(F.min("_pos").alias("_pos"))
    )
    rank = F.row_number().over(Window.partitionBy(session, "token").orderBy("_pos", "surface", "before", "after"))
    numbered = places.withColumn("site_no", rank).drop("_pos")
    return numbered if most is None else numbered.where(F.col("site_no") <= most)


def _shared(a: Column, b: Column, cut) -> Column:
    """How many characters two strings share at one end."""
    ks = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(ks, lambda k: cut(a, k) == cut(b, k)))


def site_score(before: Column, after: Column, site: Column) -> Column:
    return _shared(before, site["before"], F.right) + _shared(after, site["after"], F.left)


def token_pattern(config: Config) -> str:
    quote = lambda s: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)
    named = {p.get("type") or p.get("name") or "CUSTOM" for p in config.custom_patterns}
    odd = sorted((t for t in named if t not in TYPE_PRECEDENCE), key=len, reverse=True)
    types = "|".join([*map(quote, odd), "[A-Z][A-Z0-9_]*"])
    return f"{quote(config.token_prefix)}(?:{types})_[0-9]+{quote(config.token_suffix)}"


def rehydrate(
    texts: DataFrame, token_map: DataFrame, sites: DataFrame, keys: list[str], session: str = "session_id", text: str = "redacted",
    config: Config | None = None,
) -> DataFrame:
    """``texts`` with ``restored``: each known token replaced by what it stood for at that place.

    The site whose surroundings agree on at least ten characters decides the surface, the earliest
    among equals; elsewhere the canonical value stands in. Unknown tokens stay.
    """
    config = config or Config()
    rule = Rule("TOKEN", token_pattern(config), raw=True, guard=lambda t: F.contains(t, F.lit(config.token_prefix)))
    found = find_spans(texts, [rule], keys, text, context=SITE_CONTEXT).withColumnRenamed("value", "token")
    listed = sites.groupBy(session, "token").agg(
        F.array_sort(F.collect_list(F.struct("site_no", "surface", "before", "after"))).alias("_sites")
    )
    known = token_map.select(session, "token", "canonical").join(listed, [session, "token"], "left")

    def scored(s):
        return F.struct(site_score(F.col("before"), F.col("after"), s).alias("n"), (-s["site_no"]).alias("r"), s["surface"].alias("v"))

    best = F.array_max(F.transform("_sites", scored))
    surface = F.when(best["n"] >= SITE_MIN_MATCH, best["v"]).otherwise(F.col("canonical"))
    edits = (
        found.join(known, [session, "token"])
        .select(*keys, F.struct("start_at", "end_at", F.coalesce(surface, "canonical").alias("token")).alias("e"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("e")).alias("_edits"))
    )
    joined = texts.join(light(materialize(edits)), keys, "left")
    back = F.when(F.col("_edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("_edits")))
    return joined.withColumn("restored", back).drop("_edits")


def distinct_findings(tokenised: DataFrame, session: list[str], order: str = "doc_id") -> DataFrame:
    """One row per distinct finding: grades of its first occurrence, and how often it occurs.

    Unlike values may share an id of 32 bits, so the id alone does not tell findings apart.
    """
    position = F.struct(F.col(order).alias("o"), F.col("start_at").alias("s"))
    first = F.min_by(F.struct("type", "value", "level", "confidence", "reason"), position)
    return (
        tokenised.groupBy(*session, "finding_id", norm(F.col("value")).alias("_norm"))
        .agg(first.alias("_f"), F.count(F.lit(1)).alias("n"))
        .select(*session, "finding_id", "_f.*", "n")
    )
