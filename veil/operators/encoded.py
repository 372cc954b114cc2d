"""Values hidden by percent-escapes, character references, spelled-out addresses or base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.text import decode_entities, decode_percent, java
from veil.operators.detect import FINDING, GATHERED, detect
from veil.operators.intervals import mark_contained
from veil.operators.rules import both, has, has_run, names, names_any_case, value_rules
from veil.operators.spans import Rule, find_spans

# Shapes of hidden regions. A region starts where its run of characters starts.
ESCAPED = r"(?<![A-Za-z0-9%+._~@-])[A-Za-z0-9%+._~@-]*(?:%[0-9A-Fa-f]{2}|&#\d{2,4};)[A-Za-z0-9%+._~@;#&-]*"
AT_WORD = r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+"
DOT_WORD = r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+"
SPELLED = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+(?:{AT_WORD})[A-Za-z0-9.-]+(?:(?:{DOT_WORD})[A-Za-z0-9-]++)++"
BASE64 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/=])"
BASE64_RUN = r"[A-Za-z0-9+/]{64,}={0,2}"
SHAPE_ONLY = ("shape", "sa_id_weak", "honorific")
MIN_DECODED, PRINTABLE = 8, 0.95

HAS_ESCAPE = both(names("%", "&#"), has(r"%[0-9A-Fa-f]{2}|&#[0-9]{2,4};"))
HAS_SPELLED = both(names_any_case("dot"), has(java(r"[\s\])]dot[\s\])]|[\[(]\s*dot", "i")))
REGION_RULES = [
    Rule("ESCAPED", ESCAPED, guard=HAS_ESCAPE),
    Rule("SPELLED", SPELLED, "i", guard=HAS_SPELLED),
    Rule("BASE64", BASE64, guard=has_run(24)),
]
BASE64_RUN_RULE = Rule("BASE64_RUN", BASE64_RUN, guard=has_run(64))


def unspell(c: Column) -> Column:
    at = F.regexp_replace(c, java(AT_WORD, "i"), "@")
    return F.regexp_replace(at, java(DOT_WORD, "i"), ".")


def decode_base64(c: Column) -> Column:
    """Text of a base64 run; bad bytes become replacement characters, an odd tail is dropped."""
    bare = F.regexp_replace(c, "=+$", "")
    whole = F.left(bare, F.length(bare) - F.when(F.length(bare) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.call_function("try_to_binary", padded, F.lit("base64")).cast("string"))


def printable_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\x20-\x7e\n\r\t]", "")) / F.length(c)


def decoded_regions(df: DataFrame, keys: list[str], text: str = "text", kinds=("ESCAPED", "SPELLED", "BASE64")) -> DataFrame:
    """Hidden regions with what they say: ``keys, kind, start_at, end_at, surface, decoded, before, after``."""
    rules = [r for r in REGION_RULES if r.type in kinds]
    names = F.array(*[F.lit(r.type) for r in rules])
    raw = F.col("value")
    decoded = (
        F.when(F.col("kind") == "ESCAPED", decode_percent(decode_entities(raw)))
        .when(F.col("kind") == "SPELLED", unspell(raw))
        .otherwise(decode_base64(raw))
    )
    readable = (F.col("kind") != "BASE64") | ((F.length("decoded") >= MIN_DECODED) & (printable_share(F.col("decoded")) >= PRINTABLE))
    return (
        find_spans(df, rules, keys, text)
        .withColumn("kind", F.get(names, F.col("rule")))
        .withColumn("decoded", decoded)
        .where(F.col("decoded").isNotNull() & (F.col("decoded") != raw) & readable)
        .select(*keys, "kind", "start_at", "end_at", raw.alias("surface"), "decoded", "before", "after")
    )


def detect_encoded(df: DataFrame, keys: list[str], config: Config, spark=None, text: str = "text", kinds=("ESCAPED", "SPELLED", "BASE64")) -> DataFrame:
    """Regions whose decoded text holds something: the longest hit names the type, base64 is a SECRET."""
    regions = decoded_regions(df, keys, text, kinds)
    carry = [*keys, "kind", "r_start", "r_end", "r_surface", "r_decoded", "r_before", "r_after"]
    inner = regions.withColumnsRenamed(
        {"start_at": "r_start", "end_at": "r_end", "surface": "r_surface", "before": "r_before", "after": "r_after"}
    ).withColumn("r_decoded", F.col("decoded"))
    hits = detect(inner, value_rules(config, spark), carry, config, text="decoded", extra=("rule",))
    longest = F.max_by("type", F.struct(F.length("value"), -F.col("rule"), -F.col("start_at")))
    is_blob = F.col("kind") == "BASE64"
    return (
        hits.groupBy(*carry)
        .agg(longest.alias("hit"))
        .select(
            *keys,
            F.when(is_blob, "SECRET").otherwise(F.col("hit")).alias("type"),
            F.col("r_start").alias("start_at"),
            F.col("r_end").alias("end_at"),
            F.when(is_blob, F.col("r_surface")).otherwise(F.col("r_decoded")).alias("value"),
            F.col("r_surface").alias("surface"),
            F.lit("structural").alias("via"),
            F.col("r_before").alias("before"),
            F.col("r_after").alias("after"),
            F.when(is_blob, GATHERED["encoded"] + 1).otherwise(GATHERED["encoded"]).alias("gathered"),
        )
        .select(*keys, *FINDING)
    )


def drop_in_base64(findings: DataFrame, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Drop findings backed by shape alone that lie inside a long base64 run."""
    runs = find_spans(df, [BASE64_RUN_RULE], keys, text, context=0)
    marked = mark_contained(findings, runs, keys, "_blob")
    return marked.where(~(F.col("_blob") & F.col("via").isin(*SHAPE_ONLY))).drop("_blob")
