"""Tokens, masking, restoring, withholding, verdicts."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import EMAIL_RE2, luhn_sql, matches_sql, pad, pick, query, re2, view
from veil.catalog.detectors import BY_KEY, DIGITS, ONLY_DIGITS
from veil.catalog.scoring import LEVEL_SQL, scored_sql
from veil.config import Config
from veil.operators import rules as R
from veil.operators import tokens as T
from veil.operators.audit import quota_state
from veil.operators.detect import detect
from veil.operators.guard import join_mentions, judged, mentioned
from veil.operators.guard import withhold as withhold_texts
from veil.operators.resolve import resolve_overlaps
from veil.operators.score import score
from veil.plans.redact import find, redact_corpus
from veil.session import materialize
from veil.sources.text import read_text

KEYS = ["session_id", "doc_id"]
SESSIONS = "SELECT lang AS session_id, doc_id, text FROM documents"
CONV = f"""SELECT conv_id AS session_id, turn AS doc_id, text || CASE WHEN turn % 2 = 1 THEN chr(10) || 'please write back to ' || {pick('turn', ['User', 'user', 'USER'])} ||
 cast(turn % 3 as string) || '@mail' || cast(conv_id % 5 as string) || '.example.com for the details of it' ELSE '' END AS text FROM conversations"""


def flagship(spark, folder: str):
    """Documents with everything found in them masked, and the number of masked places."""
    corpus = read_text(spark, f"{folder}/documents.parquet", session_col="lang")
    done = redact_corpus(corpus, Config())
    places = done.findings.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_masked"), F.countDistinct("token").alias("n_values"))
    return done.redacted.join(places, KEYS, "left").select(
        "session_id", "doc_id", "redacted", F.coalesce("n_masked", F.lit(0)).alias("n_masked"), F.coalesce("n_values", F.lit(0)).alias("n_values")
    )


query("redact_corpus")(flagship)


# ---- findings of the documents, one session per language
_ONE = {
    "EMAIL": (EMAIL_RE2, "text", "true", "structural"),
    "IPV4": (re2(R.IPV4), "text", "true", "shape"),
    "CREDIT_CARD": (r"\b\d(?:[ \-]?\d){12,18}\b", ONLY_DIGITS, f"length({DIGITS}) BETWEEN 13 AND 19 AND {luhn_sql(DIGITS)}", "checksum"),
}


def findings_sql(view_sql: str, types=("EMAIL", "IPV4", "CREDIT_CARD")) -> str:
    parts = []
    for t in types:
        pattern, search, valid, via = _ONE[t]
        parts.append(
            f"SELECT session_id, doc_id, text, start_at, value, '{t}' AS type, '{via}' AS via FROM ({matches_sql(view_sql, pattern, search=search, keys='session_id, doc_id')} SELECT * FROM e) q WHERE {valid}"
        )
    return "WITH f AS (" + " UNION ALL ".join(parts) + ")"


STAFF = r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com"


@query(
    "rule_registry",
    findings_sql(SESSIONS, ("EMAIL",))
    + f""" SELECT session_id, doc_id, start_at, start_at + length(value) AS end_at, value,
 CASE WHEN regexp_full_match(value, '{STAFF}') AND cast(regexp_extract(value, '[.]([0-9]+)@', 1) AS int) % 3 = 0 THEN 'STAFF_MAIL' ELSE 'EMAIL' END AS type FROM f""",
)
def rule_registry(spark, folder):
    """A user's rule with a validator, which takes the place of the built-in one where it holds."""
    by_number = lambda v: F.regexp_extract(v, "[.]([0-9]+)@", 1).cast("int") % 3 == 0
    config = R.register_rule(Config.only("EMAIL"), "STAFF_MAIL", STAFF, by_number, of="EMAIL")
    found = find(view(spark, folder, SESSIONS, *KEYS), config)
    return found.select(*KEYS, F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "value", "type")


def token_steps(view_sql: str, types=("EMAIL", "IPV4", "CREDIT_CARD")) -> str:
    """Relation ``k``: kept findings with their token; ``tm``: the token map."""
    return (
        scored_sql(findings_sql(view_sql, types))
        + """, kept AS (SELECT *, lower(value) AS norm FROM g WHERE points >= 35),
fst AS (SELECT session_id, type, norm, min(doc_id * 10000000 + start_at) AS pos, arg_min(value, doc_id * 10000000 + start_at) AS canonical FROM kept GROUP BY session_id, type, norm),
tm AS (SELECT session_id, type, norm, row_number() OVER (PARTITION BY session_id, type ORDER BY pos) AS ordinal, canonical FROM fst),
k AS (SELECT kept.*, '[' || type || '_' || cast(ordinal AS string) || ']' AS token, start_at + length(value) AS end_at FROM kept JOIN tm USING (session_id, type, norm)),
p AS (SELECT *, coalesce(lag(end_at) OVER (PARTITION BY session_id, doc_id ORDER BY start_at), 0) AS prev FROM k)"""
    )


def masked_sql(view_sql: str) -> str:
    return f""", r AS (SELECT session_id, doc_id, string_agg(substr(text, cast(prev AS int) + 1, cast(start_at - prev AS int)) || token, '' ORDER BY start_at) AS head, max(end_at) AS last FROM p GROUP BY session_id, doc_id),
masked AS (SELECT v.session_id, v.doc_id, v.text, CASE WHEN r.last IS NULL THEN v.text ELSE r.head || substr(v.text, cast(r.last AS int) + 1) END AS redacted FROM ({view_sql}) v LEFT JOIN r ON v.session_id = r.session_id AND v.doc_id = r.doc_id)"""


def found(spark, folder, sql=SESSIONS, types=("EMAIL", "IPV4", "CREDIT_CARD")):
    corpus = view(spark, folder, sql, *KEYS)
    return corpus, resolve_overlaps(score(detect(corpus, [BY_KEY[t] for t in types], KEYS)), KEYS)


def masked(spark, folder, sql=SESSIONS, types=("EMAIL", "IPV4", "CREDIT_CARD")):
    corpus, kept = found(spark, folder, sql, types)
    kept = materialize(kept)  # texts are searched once
    token_map = T.assign_tokens(kept)
    tokenised = materialize(T.attach_tokens(kept, token_map))
    return corpus, tokenised, token_map, T.redact(corpus, tokenised, KEYS)


@query(
    "token_assign",
    token_steps(SESSIONS) + " SELECT session_id, type, norm, ordinal, '[' || type || '_' || cast(ordinal AS string) || ']' AS token, canonical FROM tm",
)
def token_assign(spark, folder):
    return T.assign_tokens(found(spark, folder)[1])


@query("redact", token_steps(SESSIONS) + masked_sql(SESSIONS) + " SELECT session_id, doc_id, redacted FROM masked")
def redact(spark, folder):
    return masked(spark, folder)[3].select(*KEYS, "redacted")


@query(
    "redact_spans",
    token_steps(SESSIONS) + f" SELECT session_id, doc_id, start_at, end_at, token, value AS original, type, {LEVEL_SQL} AS level, points / 100.0 AS confidence FROM k",
)
def redact_spans(spark, folder):
    corpus, tokenised, _, _ = masked(spark, folder)
    spans = T.redact_spans(corpus, tokenised, KEYS).where("spans is not null").select(*KEYS, F.explode("spans").alias("s")).select(*KEYS, "s.*")
    return spans.select(*KEYS, F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "token", "original", "type", "level", "confidence")


@query(
    "scan",
    token_steps(SESSIONS)
    + f""" SELECT session_id, type, norm, arg_min({LEVEL_SQL}, doc_id * 10000000 + start_at) AS level, arg_min(points, doc_id * 10000000 + start_at) / 100.0 AS confidence, count(*) AS n, '[' || type || ']' AS token
 FROM kept GROUP BY session_id, type, norm""",
)
def scan(spark, folder):
    """Dry run: distinct findings, least certain first."""
    listed = T.distinct_findings(found(spark, folder)[1], ["session_id"])
    return listed.select(
        "session_id", "type", F.lower("value").alias("norm"), "level", "confidence", "n", F.concat(F.lit("["), "type", F.lit("]")).alias("token")
    ).orderBy("confidence", "type")


@query("redact_conversation", token_steps(CONV, ("EMAIL",)) + masked_sql(CONV) + " SELECT session_id, doc_id, redacted FROM masked")
def redact_conversation(spark, folder):
    """One token namespace per conversation, numbered in the order of turns."""
    return masked(spark, folder, CONV, ("EMAIL",))[3].select(*KEYS, "redacted")


@query(
    "sites",
    token_steps(CONV, ("EMAIL",))
    + """, pl AS (SELECT session_id, token, value AS surface, right(bef, 40) AS before, left(aft, 40) AS after, min(doc_id * 10000000 + start_at) AS pos FROM k GROUP BY ALL)
SELECT session_id, token, surface, before, after, site_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id, token ORDER BY pos) AS site_no FROM pl) WHERE site_no <= 32""",
)
def sites(spark, folder):
    places = T.token_sites(masked(spark, folder, CONV, ("EMAIL",))[1])
    return places.withColumn("site_no", F.col("site_no").cast("bigint"))


@query("rehydrate", f"SELECT session_id, doc_id, text AS restored FROM ({CONV})")
def rehydrate(spark, folder):
    """Every spelling comes back where it stood, because its surroundings are remembered."""
    _, tokenised, token_map, done = masked(spark, folder, CONV, ("EMAIL",))
    return T.rehydrate(done, token_map, T.token_sites(tokenised), KEYS).select(*KEYS, "restored")


@query("roundtrip_check", f"SELECT 'same' AS outcome, count(*) AS n FROM ({SESSIONS})")
def roundtrip_check(spark, folder):
    _, tokenised, token_map, done = masked(spark, folder)
    back = T.rehydrate(done, token_map, T.token_sites(tokenised), KEYS)
    same = F.when(F.col("restored") == F.col("text"), "same").otherwise("changed")
    return back.groupBy(same.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("changed_only", token_steps(SESSIONS) + masked_sql(SESSIONS) + " SELECT session_id, doc_id, redacted FROM masked WHERE redacted <> text")
def changed_only(spark, folder):
    return T.changed_only(masked(spark, folder)[3]).select(*KEYS, "redacted")


NOTICE = "[withheld: the allowance of this workspace is used up]"
# each language is a tenant whose allowance is a fixed number of masked values
PLANS_SQL = "SELECT DISTINCT lang AS tenant, 'trial' AS plan, cast(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN -1 ELSE 100000 END AS bigint) AS limit_n, cast(0 AS bigint) AS credits FROM documents"


@query(
    "withhold",
    token_steps(SESSIONS) + masked_sql(SESSIONS)
    + f""", u AS (SELECT session_id, count(*) AS used FROM k GROUP BY session_id)
SELECT m.session_id, doc_id, CASE WHEN pl.limit_n >= 0 AND coalesce(u.used, 0) >= pl.limit_n THEN '{NOTICE}' ELSE redacted END AS shown
FROM masked m LEFT JOIN ({PLANS_SQL}) pl ON pl.tenant = m.session_id LEFT JOIN u ON u.session_id = m.session_id""",
)
def withhold(spark, folder):
    _, tokenised, _, done = masked(spark, folder)
    used = tokenised.groupBy(F.col("session_id").alias("tenant")).agg(F.count(F.lit(1)).alias("used"))
    state = quota_state(used, spark.sql(PLANS_SQL))
    return withhold_texts(done, state, "session_id", NOTICE).select(*KEYS, "shown")


PROMPTS = f"""SELECT c_custkey AS prompt_id, 'Please check ' || {pick('c_custkey', ['mine@acme.com', 'nothing', 'the card'])} || ' and @docs/f' || cast(c_custkey % 300 as string) || '.txt, (see @docs/f' || cast(c_custkey % 7 as string) || '.txt) a@b' AS prompt FROM customer"""
FILES = "SELECT 'docs/f' || cast(doc_id as string) || '.txt' AS path, n_chars * 100 AS size, text AS content FROM documents"


@query(
    "src_mentions",
    f"""WITH p AS ({PROMPTS}), fl AS (SELECT * FROM ({FILES}) WHERE size <= 2097152),
m AS (SELECT DISTINCT prompt_id, path FROM (SELECT prompt_id, unnest(['docs/f' || cast(prompt_id % 300 AS string) || '.txt', 'docs/f' || cast(prompt_id % 7 AS string) || '.txt']) AS path FROM p))
SELECT prompt_id, 'your prompt' AS "where", length(prompt) AS n FROM p UNION ALL SELECT prompt_id, '@' || path, length(content) FROM m JOIN fl USING (path)""",
)
def src_mentions(spark, folder):
    prompts = view(spark, folder, PROMPTS, "prompt_id")
    texts = join_mentions(prompts, spark.sql(FILES), ["prompt_id"])
    return texts.select("prompt_id", "where", F.length("text").cast("bigint").alias("n"))


@query(
    "guard",
    f"""WITH p AS ({PROMPTS}), fl AS (SELECT * FROM ({FILES}) WHERE size <= 2097152),
m AS (SELECT DISTINCT prompt_id, path FROM (SELECT prompt_id, unnest(['docs/f' || cast(prompt_id % 300 AS string) || '.txt', 'docs/f' || cast(prompt_id % 7 AS string) || '.txt']) AS path FROM p)),
t AS (SELECT prompt_id, 'your prompt' AS place, prompt AS text FROM p UNION ALL SELECT prompt_id, '@' || path, content FROM m JOIN fl USING (path)),
h AS (SELECT prompt_id, place, unnest(regexp_extract_all(text, '{EMAIL_RE2}')) AS value FROM t),
d AS (SELECT prompt_id, count(DISTINCT place || ' ' || lower(value)) AS n_values, count(*) AS n_hits FROM h GROUP BY prompt_id)
SELECT p.prompt_id, CASE WHEN d.prompt_id IS NULL THEN 'allow' ELSE 'block' END AS verdict, coalesce(n_values, 0) AS n_values, coalesce(n_hits, 0) AS n_hits FROM p LEFT JOIN d ON d.prompt_id = p.prompt_id""",
)
def guard(spark, folder):
    prompts = view(spark, folder, PROMPTS, "prompt_id")
    find_mail = lambda texts, keys: resolve_overlaps(score(detect(texts, [BY_KEY["EMAIL"]], keys)), keys)
    told = judged(mentioned(prompts, spark.sql(FILES), ["prompt_id"], find_mail), prompts, ["prompt_id"])
    counted = F.aggregate("summary", F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    return told.select(
        "prompt_id", "verdict", F.coalesce(F.size("summary"), F.lit(0)).cast("bigint").alias("n_values"), F.coalesce(counted, F.lit(0)).cast("bigint").alias("n_hits")
    ).withColumn("n_values", F.greatest("n_values", F.lit(0)))
