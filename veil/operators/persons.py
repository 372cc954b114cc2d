"""Names in running text: initials, capitalised runs anchored by a known given name or a title, capitals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.text import java
from veil.lexicons import Lexicons
from veil.operators.labels import first_words, kept_words, word_norm
from veil.operators.spans import Rule

# Shapes of a name.
INITIALS = r"(?<![\p{L}\p{N}])(?:\p{Lu}\.[ \t]?){1,3}\p{Lu}[\p{L}\p{M}'’\-]*[\p{Ll}\p{M}'’](?![\p{L}\p{N}])"
TITLE_RUN = (
    r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{M}'’.\-]*[\p{Ll}\p{M}'’]"
    r"(?:[ ]+\p{Lu}[\p{L}\p{M}'’.\-]*[\p{Ll}\p{M}'’]){0,2}(?![\p{L}\p{N}])"
)
CAPS_RUN = r"\<[A-Z][A-Z'’.\-]*[A-Z](?:[ \t]+[A-Z][A-Z'’.\-]*[A-Z]){1,2}\>"
TITLE_BEFORE = r"(?:^|(?<![A-Za-z0-9_]))([A-Za-z]{2,12})\.?[" + r"\s" + r"]+$"

PERSON_RULES = [
    Rule("PERSON", INITIALS, via="gazetteer", name="INITIALS"),
    Rule("PERSON", TITLE_RUN, name="TITLE_RUN"),
    Rule("PERSON", CAPS_RUN, via="gazetteer", name="CAPS_RUN"),
]


def judge_runs(hits: DataFrame, lex: Lexicons, mode: str = "balanced") -> DataFrame:
    """Keep the capitalised runs that carry a name signal and cut them to the name.

    ``hits`` has ``run`` (rule name, NULL for other rules), ``start_at, end_at, value, via, before,
    after``. A narrow step; rows of other rules pass through.
    """
    known, stop, titles = list(lex.first_names), list(lex.stopwords), list(lex.honorifics)
    words, lower, run = F.col("_w"), F.col("_l"), F.col("run")
    is_title = F.coalesce(run == "TITLE_RUN", F.lit(False))
    title_first = F.get(lower, F.lit(0)).isin(titles) & (F.size(words) >= 2)
    title_before = F.lower(F.regexp_extract(F.right("before", F.lit(14)), java(TITLE_BEFORE), 1)).isin(titles)
    position = F.array_position(F.transform(lower, lambda w: w.isin(known)), True)  # 1-based, 0 when absent
    anchored = (position > 0) & (position < F.size(words))
    cut_at = (
        F.when(title_first, F.get(words, F.lit(1)))
        .when(title_before, F.get(words, F.lit(0)))
        .when(anchored, F.get(words, (position - 1).cast("int")))
    )
    caps_ok = F.get(lower, F.lit(0)).isin(known) & ~F.exists(lower, lambda w: w.isin(stop))
    found = (
        hits.withColumn("_w", F.when(run.isNotNull(), F.split("value", java(r"\s+"))))
        .withColumn("_l", F.transform("_w", word_norm))
        .withColumn(
            "_from",
            F.when(is_title, F.when(~F.forall("_l", lambda w: w.isin(stop)), F.instr(F.col("value"), cut_at) - 1))
            .when(run == "CAPS_RUN", F.when(caps_ok, 0))
            .otherwise(0),
        )
        .withColumn("_by_title", is_title & (title_first | title_before))
        .where("_from >= 0")
        .withColumn("_w", F.when(is_title, F.split(F.expr("substring(value, _from + 1)"), java(r"\s+"))))
    )
    named = F.exists("_w", lambda w: word_norm(w).isin(known))
    if mode == "strict":
        found = found.where(~F.col("_by_title") | named)
    keep = kept_words(words, lambda w: word_norm(w).isin(stop) & ~F.lower(w).isin(known))
    kept = F.slice(words, 1, keep)
    by_name = F.exists(kept, lambda w: word_norm(w).isin(known))
    return (
        found.withColumn("via", F.when(is_title, F.when(by_name, "gazetteer").otherwise("honorific")).otherwise(F.col("via")))
        .withColumn("_v", F.when(is_title, first_words(F.expr("substring(value, _from + 1)"), keep)).otherwise(F.col("value")))
        .withColumn("after", F.when(is_title, F.left(F.concat(F.expr("substring(value, _from + length(_v) + 1)"), "after"), F.lit(42))).otherwise(F.col("after")))
        .withColumn("before", F.when(is_title, F.right(F.concat("before", F.expr("left(value, _from)")), F.lit(42))).otherwise(F.col("before")))
        .withColumn("start_at", F.col("start_at") + F.col("_from"))
        .withColumn("end_at", F.col("start_at") + F.length("_v"))
        .withColumn("value", F.col("_v"))
        .drop("_w", "_l", "_by_title", "_from", "_v")
    )


def without_shadowed_caps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Drop capital runs that overlap a name found in title case, or an earlier capital run.

    Runs of one rule never overlap each other, so a running maximum in text order decides: the
    largest end seen so far, and the smallest start still to come, among the other names.
    """
    order = Window.partitionBy(*keys).orderBy("start_at", "end_at")
    other_end = F.when(F.col("run").isin("TITLE_RUN", "INITIALS"), F.col("end_at"))
    other_start = F.when(F.col("run").isin("TITLE_RUN", "INITIALS"), F.col("start_at"))
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        found.withColumn("_end_before", F.max(other_end).over(back))
        .withColumn("_start_after", F.min(other_start).over(ahead))
        .where(
            ~F.col("run").eqNullSafe("CAPS_RUN")
            | (
                (F.coalesce("_end_before", F.lit(-1)) <= F.col("start_at"))
                & F.coalesce(F.col("_start_after") >= F.col("end_at"), F.lit(True))
            )
        )
        .drop("_end_before", "_start_after")
    )
