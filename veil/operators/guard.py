"""Verdicts on prompts, and withholding what may not be shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.operators.tokens import distinct_findings
from veil.session import light, materialize

MAX_MENTION_BYTES = 2 * 1024 * 1024  # files beyond it are reported, not read; None reads all
MENTION = r"(?:^|[\s])@(\S+)"


def mentions(prompts: DataFrame, keys: list[str], text: str = "prompt") -> DataFrame:
    """Files a prompt mentions: ``keys, path``."""
    from veil.functions.text import java

    paths = F.regexp_extract_all(F.col(text), F.lit(java(MENTION)), F.lit(1))
    return prompts.select(*keys, F.explode(F.array_distinct(paths)).alias("_m")).select(
        *keys, F.regexp_replace("_m", r"[.,;:)\]]+$", "").alias("path")
    )


def join_mentions(prompts: DataFrame, files: DataFrame, keys: list[str], text: str = "prompt", most_bytes: int | None = MAX_MENTION_BYTES) -> DataFrame:
    """Texts to inspect per prompt: the prompt itself and every mentioned file of at most ``most_bytes``.

    ``files``: path, size, content. Result: ``keys, where, text``. ``skipped_mentions`` lists the files left out.
    """
    own = prompts.select(*keys, F.lit("your prompt").alias("where"), F.col(text).alias("text"))
    small = (files if most_bytes is None else files.where(F.col("size") <= most_bytes)).select("path", "content")
    named = mentions(prompts, keys, text).distinct().join(small, "path")
    return own.unionByName(named.select(*keys, F.concat(F.lit("@"), "path").alias("where"), F.col("content").alias("text")))


def skipped_mentions(prompts: DataFrame, files: DataFrame, keys: list[str], text: str = "prompt", most_bytes: int = MAX_MENTION_BYTES) -> DataFrame:
    """Mentioned files that are too large to be read: ``keys, path, size``."""
    return mentions(prompts, keys, text).distinct().join(files.where(F.col("size") > most_bytes).select("path", "size"), "path").select(*keys, "path", "size")


def verdicts(findings: DataFrame, prompts: DataFrame, keys: list[str], mode: str = "block", gate_open: Column | None = None) -> DataFrame:
    """Per prompt: block, warn or allow, with a summary of types, levels, counts and reasons but no values."""
    return judged(distinct_findings(findings, [*keys, "where"], "start_at"), prompts, keys, mode, gate_open)


def mentioned(prompts: DataFrame, files: DataFrame, keys: list[str], find: Callable[[DataFrame, list[str]], DataFrame], text: str = "prompt", most_bytes: int | None = MAX_MENTION_BYTES) -> DataFrame:
    """Distinct findings of every prompt and of the files it mentions: ``keys, where`` and what ``distinct_findings`` gives.

    The same as for the texts of ``join_mentions``, but ``find`` (texts and their keys to resolved findings) reads a file once,
    however many prompts mention it: what was found goes to the prompts, not the text.
    """
    own = distinct_findings(find(prompts.select(*keys, F.col(text).alias("text")), keys), keys, "start_at")
    small = files if most_bytes is None else files.where(F.col("size") <= most_bytes)
    named = mentions(prompts, keys, text).distinct()
    read = small.select("path", F.col("content").alias("text")).join(light(named.select("path").distinct()), "path", "left_semi")
    told = light(materialize(distinct_findings(find(read, ["path"]), ["path"], "start_at")))
    there = named.join(told, "path").withColumn("where", F.concat(F.lit("@"), "path")).drop("path")
    return own.withColumn("where", F.lit("your prompt")).unionByName(there)


def judged(per_value: DataFrame, prompts: DataFrame, keys: list[str], mode: str = "block", gate_open: Column | None = None) -> DataFrame:
    """``verdicts`` from distinct findings of each prompt and place."""
    line = F.struct("where", "confidence", "type", "level", "n", "reason")
    summary = per_value.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("summary"))
    met = prompts.select(*keys).join(summary, keys, "left")
    shut = ~gate_open if gate_open is not None else F.lit(False)
    hit = F.col("summary").isNotNull()
    if mode == "off":
        hit = F.lit(False)
    action = F.when(hit & shut, "block").when(hit, F.lit("warn" if mode == "warn" else "block")).otherwise("allow")
    return met.withColumn("verdict", action)


def withhold(redacted: DataFrame, quota: DataFrame, tenant: str, notice: str, masked: str = "redacted", failed: Column | None = None) -> DataFrame:
    """Replace the masked text by a notice for tenants that have run out, or where masking failed."""
    # a tenant may own most of the texts, so these stay where they are while those that have run out are few
    paused = light(materialize(quota.where("paused").select(F.col("tenant").alias(tenant), F.lit(True).alias("_paused"))))
    joined = redacted.join(paused, tenant, "left")
    broken = failed if failed is not None else F.col(masked).isNull()
    hide = F.coalesce(F.col("_paused"), F.lit(False)) | broken
    return joined.withColumn("shown", F.when(hide, F.lit(notice)).otherwise(F.col(masked))).drop("_paused")
