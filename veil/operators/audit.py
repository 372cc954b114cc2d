"""Facts about what was masked: events without values, duplicates, usage, quotas, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.crypto import blind_index, encrypt, mask_preview
from veil.functions.text import norm

EVENT_COLUMNS = ("type", "status", "convo_ref", "blind_idx", "cipher")
LOW_MARK = 25  # headroom at which a tenant is told it runs low


def leak_events(token_map: DataFrame, previous: DataFrame | None, ipad: Column, opad: Column, enc_key: Column | None, session: str = "session_id") -> DataFrame:
    """One event per value masked for the first time: type, status, where, fingerprint, sealed preview.

    ``previous`` is the token map of the last snapshot. The value itself is not among the columns.
    """
    fresh = token_map
    if previous is not None:
        fresh = token_map.join(previous.select(session, "type", "norm"), [session, "type", "norm"], "left_anti")
    preview = mask_preview(F.col("canonical"), F.col("type"))
    return fresh.select(
        "type", F.lit("prevented").alias("status"), F.col(session).cast("string").alias("convo_ref"),
        blind_index(F.col("canonical"), ipad, opad).alias("blind_idx"),
        (encrypt(preview, enc_key) if enc_key is not None else F.lit(None).cast("string")).alias("cipher"),
    )


def dedupe_events(events: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Events by fingerprint with how often each leaked; fingerprints declared harmless are left out."""
    kept = events if suppressed is None else events.join(suppressed.select("blind_idx").distinct(), "blind_idx", "left_anti")
    return kept.groupBy("blind_idx", "type").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("convo_ref").alias("places"))


def plaintext_rows(table: DataFrame, column: str) -> DataFrame:
    """Rows of an audit table whose sealed column is not ciphertext."""
    from veil.functions.crypto import looks_encrypted

    return table.where(~looks_encrypted(F.coalesce(F.col(column), F.lit(""))))


def usage_counts(findings: DataFrame, batch: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values and occurrences by batch and type.

    Values are counted by fingerprint pairs first, so one frequent value never lands on one task.
    """
    if approximate:
        return findings.groupBy(*batch, "type").agg(
            F.approx_count_distinct(norm(F.col("value"))).alias("distinct_values"), F.count(F.lit(1)).alias("occurrences")
        )
    by_value = findings.groupBy(*batch, "type", norm(F.col("value")).alias("_norm")).agg(F.count(F.lit(1)).alias("_n"))
    return by_value.groupBy(*batch, "type").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("_n").alias("occurrences"))


def distinct_sketches(findings: DataFrame, by: list[str], value: Column | None = None, lg_k: int = 12) -> DataFrame:
    """Audit facts that can be added up later: a sketch of the distinct values and the occurrences, by ``by`` and type.

    Sketches hold hashes cut to some bits, no values; pass a keyed fingerprint as ``value`` where even these should tell nothing.
    They are merged on both sides of the shuffle, so a frequent value or batch is no hot key. Null values count as occurrences only.
    """
    what = norm(F.col("value")) if value is None else value
    return findings.groupBy(*by, "type").agg(F.hll_sketch_agg(what, lg_k).alias("sketch"), F.count(F.lit(1)).alias("occurrences"))


def distinct_over(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of any window, from its stored sketches: a value that came in several of them counts once.

    The standard error is 1.04 / sqrt(2 ** lg_k), 1.6 % at the default, and nothing for some hundred values.
    """
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("_sketch"), F.sum("occurrences").alias("occurrences"))
    return merged.withColumn("distinct_values", F.hll_sketch_estimate("_sketch")).drop("_sketch")


def quota_state(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Where each tenant stands: allowance first, then credits.

    ``usage``: tenant, used (summed here). ``plans``: tenant, plan, limit_n (-1 for no limit), credits.
    """
    used = usage.groupBy("tenant").agg(F.sum("used").alias("used"))
    state = plans.join(used, "tenant", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    unlimited = F.col("limit_n") == -1
    left = F.greatest(F.col("limit_n") - F.col("used"), F.lit(0))
    drawn = F.greatest(F.col("used") - F.col("limit_n"), F.lit(0))
    credits = F.greatest(F.col("credits") - drawn, F.lit(0))
    return (
        state.withColumn("remaining", F.when(~unlimited, left))
        .withColumn("credits_left", F.when(unlimited, F.col("credits")).otherwise(credits))
        .withColumn("headroom", F.when(~unlimited, left + credits))
        .withColumn("pct", F.when(~unlimited & (F.col("limit_n") > 0), F.round(F.col("used") * 100.0 / F.col("limit_n")).cast("bigint")))
        .withColumn("low", F.coalesce(F.col("headroom").between(1, LOW_MARK), F.lit(False)))
        .withColumn("paused", F.coalesce(F.col("headroom") <= 0, F.lit(False)))
    )


def over_limit_at(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Per usage row, the tenant's running total and whether it had run out by then.

    Usage is first summed to one row per tenant and minute, so the running window sees time steps, not events.
    """
    minute = usage.groupBy("tenant", F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("used").alias("used"))
    so_far = Window.partitionBy("tenant").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = minute.withColumn("total", F.sum("used").over(so_far)).join(plans.select("tenant", "limit_n", "credits"), "tenant")
    over = (F.col("limit_n") != -1) & (F.col("total") >= F.col("limit_n") + F.col("credits"))
    return running.select("tenant", "minute", "used", "total", over.alias("over_limit"))


def hotspots(findings: DataFrame, dims: list[str]) -> DataFrame:
    """Findings by every combination of the given dimensions, totals included."""
    return findings.cube(*dims).agg(F.count(F.lit(1)).alias("hits"), F.grouping_id().cast("bigint").alias("grouping_level"))
