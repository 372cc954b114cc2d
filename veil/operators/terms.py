"""Always-mask terms held in a table: matched by hash join on runs of words, not by one huge pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.text import norm, unmarked
from veil.operators.detect import GATHERED
from veil.operators.spans import attach_context
from veil.operators.words import word_array

WORD_CHARS = r"[\p{L}\p{M}\p{N}_]+"


def detect_terms(df: DataFrame, terms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Findings (type CUSTOM, via ``term``) of every term of a one-column table, in any case.

    Text runs of as many words as some term has are keyed by the lower-cased words and joined to the
    terms; the characters between the words, and the signs a term begins or ends with, are then compared
    exactly. Only the distinct word counts of the terms come to the driver. A term without letters or
    digits has no words to be found by.
    """
    term = F.lower(F.col(terms.columns[0]))
    listed = (
        terms.select(term.alias("term"))
        .where(norm(F.col("term")) != "")
        .distinct()
        .withColumn("_words", F.regexp_extract_all("term", F.lit(WORD_CHARS), F.lit(0)))
        .where(F.size("_words") > 0)
        .select(
            "term", F.array_join("_words", " ").alias("_key"), F.size("_words").alias("_n"),
            F.length(F.regexp_extract("term", r"^[^\p{L}\p{M}\p{N}_]*", 0)).alias("_lead"),
            F.length(F.regexp_extract("term", r"[^\p{L}\p{M}\p{N}_]*$", 0)).alias("_tail"),
        )
    )
    sizes = listed.groupBy("_n").agg(F.max("_lead").alias("lead"), F.max("_tail").alias("tail")).collect()
    counts = sorted(r["_n"] for r in sizes)
    lead, tail = max((r["lead"] for r in sizes), default=0), max((r["tail"] for r in sizes), default=0)
    if not counts:
        listed, counts = listed.limit(0), [1]
    words = F.filter("_w", lambda w, i: i % 2 == 1)
    located = df.select(*keys, word_array(unmarked(F.col(text)), WORD_CHARS).alias("_w")).withColumn("_words", words)

    def runs_of(n: int):
        def run(i):
            first, last = F.element_at("_words", i), F.element_at("_words", i + n - 1)
            inside = F.slice("_w", i * 2, F.lit(2 * n - 1))
            return F.struct(
                F.lower(F.array_join(F.transform(F.slice("_words", i, F.lit(n)), lambda w: w["p"]), " ")).alias("key"),
                first["s"].alias("start_at"),
                (last["s"] + F.length(last["p"])).alias("end_at"),
                F.array_join(F.transform(inside, lambda w: w["p"]), "").alias("value"),
                F.right(F.element_at("_w", i * 2 - 1)["p"], F.lit(lead)).alias("before"),
                F.left(F.element_at("_w", (i + n) * 2 - 1)["p"], F.lit(tail)).alias("after"),
            )

        starts = F.sequence(F.lit(1), F.size("_words") - n + 1)
        return F.when(F.size("_words") >= n, F.transform(starts, run)).otherwise(F.transform(F.array().cast("array<int>"), run))

    found = (
        located.select(*keys, F.explode(F.flatten(F.array(*[runs_of(n) for n in counts]))).alias("_r"))
        .select(*keys, "_r.*")
        .join(listed.select(F.col("_key").alias("key"), "term", "_lead", "_tail"), "key")
        .withColumn("value", F.concat(F.right("before", F.col("_lead")), "value", F.left("after", F.col("_tail"))))
        .where(F.lower("value") == F.col("term"))
        .withColumns({"start_at": F.col("start_at") - F.col("_lead"), "end_at": F.col("end_at") + F.col("_tail")})
        .select(*keys, F.lit("CUSTOM").alias("type"), "start_at", "end_at", "value", F.col("value").alias("surface"), F.lit("term").alias("via"), F.lit(GATHERED["term"]).alias("gathered"))
    )
    return attach_context(found, df, keys, text)
