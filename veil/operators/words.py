"""Words of a text with their places, and runs of neighbouring words as join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import CLOSE, OPEN, unmarked
from veil.operators.spans import running_starts

# a percent-escape separates words although it contains letters and digits
WORD_OR_ESCAPE = r"(%[0-9A-Fa-f]{2})|([A-Za-z0-9]+)"


def word_array(text: Column, word: str = "[A-Za-z0-9]+", mark: str | None = None) -> Column:
    """Alternating gaps and words of a marker-free text, each with its offset: ``{p, s}``."""
    marked = F.regexp_replace(text, F.lit(word), F.lit(mark or OPEN + "$0" + CLOSE))
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    starts = running_starts(F.transform(parts, F.length))
    return F.arrays_zip(parts.alias("p"), starts.alias("s"))


def located_words(df: DataFrame, keys: list[str], text: str = "text", word: str = "[A-Za-z0-9]+", mark: str | None = None) -> DataFrame:
    """``keys``, carried columns and ``_w``: the alternating array of gaps and words."""
    return df.withColumn("_t", unmarked(F.col(text))).withColumn("_w", word_array(F.col("_t"), word, mark)).drop("_t")
