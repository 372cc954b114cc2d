"""Wallet recovery phrases: runs of words that all belong to a word list."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.operators.detect import GATHERED
from veil.operators.spans import CONTEXT, Rule, find_spans

SHORTEST_PHRASE = 12  # words; a longer run holds a phrase and words around it that happen to be listed, and all of it goes
# Fixed value: SHA-256 of the published English wallet list, words joined and ended by newlines.
WALLET_LIST_SHA256 = "2f5eed53a4727b4bf8880d8f3f199efc90e58503646d9ff8eff3a2ed3b24dbda"
# a run of at least twelve short lower-case words, the only places worth splitting into words
CANDIDATE = r"(?<![A-Za-z0-9_])[a-z]{3,8}+(?![A-Za-z0-9_])(?:[ \t\r\n,]++[a-z]{3,8}+(?![A-Za-z0-9_])){11,}+"


def is_wallet_list(words: list[str]) -> bool:
    """Whether a list is the published one, in its published order."""
    return hashlib.sha256(("\n".join(words) + "\n").encode()).hexdigest() == WALLET_LIST_SHA256


def seed_phrases(df: DataFrame, wordlist: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Findings of runs of twelve or more words that are all on the list.

    ``wordlist`` is a one-column table, 2,048 rows for the published list. Candidate runs are found by
    shape; their words are joined to the list, and unbroken runs fall out as gaps-and-islands.
    """
    runs = find_spans(df, [Rule("SEED_PHRASE", CANDIDATE, raw=True)], keys, text, context=CONTEXT)
    run_keys = [*keys, "r_start"]
    words = find_spans(
        runs.select(*keys, F.col("start_at").alias("r_start"), "value"), [Rule("WORD", "[a-z]+", raw=True)], run_keys, "value", context=0
    ).select(*run_keys, "start_at", "end_at", F.col("value").alias("word"))
    places = words.withColumn("pos", F.row_number().over(Window.partitionBy(*run_keys).orderBy("start_at")))
    listed = wordlist.select(F.col(wordlist.columns[0]).alias("word")).distinct()
    member = places.join(listed, "word", "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*run_keys).orderBy("pos"))
    phrases = (
        member.withColumn("_island", island)
        .groupBy(*run_keys, "_island")
        .agg(F.count(F.lit(1)).alias("n"), F.min("start_at").alias("a"), F.max("end_at").alias("b"))
        .where(F.col("n") >= SHORTEST_PHRASE)
    )
    context = runs.select(*keys, F.col("start_at").alias("r_start"), F.col("value").alias("_run"), "before", "after")
    a, b = F.col("a"), F.col("b")
    value = F.substring("_run", a + 1, b - a)
    start = (F.col("r_start") + a).cast("int")
    return phrases.join(context, run_keys).select(
        *keys, F.lit("SEED_PHRASE").alias("type"), start.alias("start_at"), (start + F.length(value)).alias("end_at"),
        value.alias("value"), value.alias("surface"), F.lit("secret").alias("via"),
        F.right(F.concat("before", F.substring("_run", F.lit(1), a)), F.lit(CONTEXT)).alias("before"),
        F.left(F.concat(F.substring("_run", b + 1, F.length("_run")), "after"), F.lit(CONTEXT)).alias("after"),
        F.lit(GATHERED["secret"]).alias("gathered"),
    )
