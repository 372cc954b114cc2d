"""Registry of queries, and builders for the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.sources.tables import register, spread

# Patterns of the checking engine, written for it and not taken from the rules.
EMAIL_RE2 = (
    r"[\p{L}0-9._%+\-]+[ ]?@[ ]?[\p{L}0-9\-]+(?:[ ][\p{Ll}0-9\-]+)?"
    r"(?:(?:\.[\p{L}0-9\-]+|[ ]\.[ ]?[\p{Ll}0-9\-]+|\.[ ][\p{Ll}0-9\-]+)(?:[ ][\p{Ll}0-9\-]+)?)*"
    r"(?:\.[\p{L}]{2,}|[ ]\.[ ]?[\p{Ll}]{2,}|\.[ ][\p{Ll}]{2,})"
)
PRIVATE_KEY_RE2 = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
CONNECTION_RE2 = r"\b[a-z][a-z0-9+]+://[^\s:/@\"\x27<>]+:[^\s/@\"\x27<>]+@[^\s\"\x27<>&]+"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def view(spark, folder: str, sql: str, *keys: str) -> DataFrame:
    """A text view written in SQL both engines read, spread over the cores."""
    register(spark, folder)
    return spread(spark.sql(sql), *(keys or ("doc_id",)))


def spans_out(df: DataFrame, *keys: str) -> DataFrame:
    """The columns detector queries report."""
    return df.select(
        *(keys or ("doc_id",)), F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"),
        "type", "value", "via",
    )


def pick(expr: str, words: list[str]) -> str:
    """SQL that chooses one of a few words by a number."""
    cases = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words))
    return f"(CASE {expr} % {len(words)} {cases} END)"


def pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def re2(pattern: str) -> str:
    """A rule pattern in the checking engine's dialect; quotes are doubled for SQL."""
    return pattern.replace(r"\<", r"\b").replace(r"\>", r"\b").replace("'", "''")


def luhn_sql(d: str) -> str:
    digit = f"cast(substr(reverse({d}), i, 1) as int)"
    return (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
        f"WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    )


def matches_sql(view_sql: str, pattern: str, lead: str = "''", value: str = "g0[i]", groups: int = 0, search: str = "text", keys: str = "doc_id") -> str:
    """CTEs ``v`` (the view) and ``e`` (one row per match: keys, text, start_at, value).

    ``g0`` holds whole matches, ``g1``.. their groups; ``lead`` is the part of a match before the value.
    """
    gs = "".join(f", regexp_extract_all(s, '{pattern}', {n}) AS g{n}" for n in range(groups + 1))
    carry = "".join(f", g{n}" for n in range(groups + 1))
    return f"""WITH v AS ({view_sql}),
s AS (SELECT *, {search} AS s FROM v),
m AS (SELECT *{gs}, regexp_split_to_array(s, '{pattern}') AS gaps FROM s WHERE regexp_matches(s, '{pattern}')),
e AS (SELECT {keys}, text,
  cast(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(g0[1:i-1], lambda x: length(x))), 0) + length({lead}) AS bigint) AS start_at,
  {value} AS value{carry}, i FROM m, unnest(range(1, len(g0) + 1)) AS t(i))"""


def spans_sql(view_sql: str, pattern: str, type_: str, via: str, valid: str = "true", keys: str = "doc_id", **kw) -> str:
    """Spans of one rule as a complete query."""
    return (
        matches_sql(view_sql, pattern, keys=keys, **kw)
        + f"\nSELECT {keys}, start_at, start_at + length(value) AS end_at, {type_} AS type, value, {via} AS via FROM e WHERE {valid}"
    )
