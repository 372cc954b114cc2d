"""Known values found again: every way the same person or address turns up in another spelling."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import matches_sql, pad, pick, query, quoted, re2, view
from veil.catalog.detectors import BY_KEY
from veil.catalog.redaction import KEYS, SESSIONS, findings_sql
from veil.config import Config
from veil.lexicons import SWEEP_STOPWORDS, Lexicons
from veil.operators import known as W
from veil.operators.detect import detect
from veil.operators.labels import label_rules
from veil.operators.spans import Rule, find_spans
from veil.session import materialize

CONFIG = Config(lexicons=Lexicons())
KNOWN = quoted(Lexicons().first_names)
LABELS = {r.key: r for r in label_rules()}
FIRST, LAST = pick("c_custkey", V.FIRST), pick("cast(floor(c_custkey / 2) as bigint)", V.LAST)


def pair_view(first_text: str, second_text: str) -> str:
    """Two texts per customer, one session each; ``f`` and ``l`` are the customer's names."""
    names = f"SELECT c_custkey AS k, {FIRST} AS f, {LAST} AS l FROM customer"
    return (
        f"SELECT k AS session_id, cast(0 as bigint) AS doc_id, {first_text} AS text, f, l FROM ({names}) a "
        f"UNION ALL SELECT k AS session_id, cast(1 as bigint) AS doc_id, {second_text} AS text, f, l FROM ({names}) b"
    )


def swept_out(df):
    return df.select(*KEYS, F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "type", "value", "surface", "via")


def sweep_query(name: str, sql: str, rules: list[str], kinds: tuple[str, ...], expected: list[tuple[str, str, str, str]], config: Config = CONFIG) -> None:
    """Learn from labels, then sweep. ``expected``: (condition, surface, value, via) of one finding in the second text."""
    oracle = f"WITH v AS ({sql}) " + " UNION ALL ".join(
        f"SELECT session_id, doc_id, cast(strpos(text, {surface}) - 1 AS bigint) AS start_at, cast(strpos(text, {surface}) - 1 + length({surface}) AS bigint) AS end_at, 'PERSON' AS type, {value} AS value, {surface} AS surface, '{via}' AS via FROM v WHERE doc_id = 1 AND {cond}"
        for cond, surface, value, via in expected
    )

    @query(name, oracle)
    def run(spark, folder):
        corpus = view(spark, folder, sql, *KEYS)
        found = materialize(detect(corpus, [LABELS[r] for r in rules], KEYS, config))
        certain = W.certain_values(found, "session_id", config)
        known = W.known_values(W.upgrade(found, certain, "session_id"), certain, "session_id", config)
        return swept_out(W.sweep(corpus, found, known, KEYS, config, kinds=kinds))


@query(
    "known_register",
    findings_sql(SESSIONS) + " SELECT session_id, lower(value) AS norm, min(type) AS declared FROM f WHERE via IN ('structural', 'checksum') GROUP BY session_id, lower(value)",
)
def known_register(spark, folder):
    """Values proved by structure or checksum, per language; addresses of machines are shape only and stay out."""
    rules = [BY_KEY[t] for t in ("EMAIL", "IPV4", "CREDIT_CARD")]
    return W.certain_values(detect(view(spark, folder, SESSIONS, *KEYS), rules, KEYS), "session_id", CONFIG)


UPGRADE = f"""SELECT c_custkey AS session_id, cast(0 as bigint) AS doc_id, '"tax_number": "0' || {pad('c_custkey', 9)} || '"' AS text FROM customer
 UNION ALL SELECT c_custkey AS session_id, cast(1 as bigint) AS doc_id, 'note 0' || {pad('c_custkey', 9)} || ' and 08' || {pad('c_custkey', 8)} AS text FROM customer"""


@query(
    "known_upgrade",
    f"""WITH c AS (SELECT c_custkey AS s, '0' || {pad('c_custkey', 9)} AS n, '08' || {pad('c_custkey', 8)} AS o FROM customer)
SELECT s AS session_id, cast(0 AS bigint) AS doc_id, 'ID' AS type, n AS value, 'field' AS via FROM c UNION ALL SELECT s, 0, 'ID', n, 'established' FROM c
UNION ALL SELECT s, 1, 'ID', n, 'established' FROM c UNION ALL SELECT s, 1, 'PHONE', o, 'shape' FROM c""",
)
def known_upgrade(spark, folder):
    """A number declared under a field name is the same thing where it merely looks like a phone."""
    found = detect(view(spark, folder, UPGRADE, *KEYS), [BY_KEY["PHONE"], LABELS["FIELD_ID"]], KEYS, CONFIG)
    return W.upgrade(found, W.certain_values(found, "session_id", CONFIG), "session_id").select(*KEYS, "type", "value", "via")


_HEAD = "'Name: ' || f || ' ' || l || '. Done'"
_ASCII_STOP = quoted(SWEEP_STOPWORDS)
_NAMED = f"(lower(f) IN ({KNOWN}) OR lower(l) IN ({KNOWN}))"
sweep_query(
    "sweep_full",
    pair_view(_HEAD, "'see https://x.org/in/' || lower(f) || '-' || lower(l) || ' and ' || f || '_' || l || '; prose ' || lower(f) || ' ' || lower(l) || ' end'"),
    ["LABEL_NAME"], ("full",),
    [("true", "lower(f) || '-' || lower(l)", "f || ' ' || l", "known_value"), ("true", "f || '_' || l", "f || ' ' || l", "known_value")],
)
sweep_query(
    "sweep_initial_surname",
    pair_view(_HEAD, "'see https://x.org/u/' || lower(substr(f, 1, 1)) || lower(l) || '87 or ' || lower(substr(f, 1, 1)) || '.' || lower(l) || ' or ' || substr(f, 1, 1) || '. ' || l || ' end'"),
    ["LABEL_NAME"], ("initial",),
    [("length(l) >= 5", "lower(substr(f, 1, 1)) || lower(l) || '87'", "f || ' ' || l", "known_value"), ("length(l) >= 5", "substr(f, 1, 1) || '. ' || l", "f || ' ' || l", "known_value")],
)
sweep_query(
    "sweep_surname_url",
    pair_view(_HEAD, "'get /cv/' || lower(l) || '2026.pdf of ' || lower(l) || ', or ' || lower(l) || 'book.pdf'"),
    ["LABEL_NAME"], ("surname",),
    [(f"length(l) >= 6 AND lower(l) NOT IN ({_ASCII_STOP})", "lower(l) || '2026'", "f || ' ' || l", "known_value")],
)
sweep_query(
    "sweep_pairs",
    pair_view("'\"first_name\": \"' || f || '\", \"last_name\": \"' || l || '\"'", "'profile https://x.org/' || f || '-' || l || ' or ' || lower(substr(f, 1, 1)) || lower(l) || '.pdf'"),
    ["FIELD_NAME"], ("pair",),
    [(f"lower(f) IN ({KNOWN}) AND length(l) >= 3", "f || '-' || l", "l", "known_value"), (f"lower(f) IN ({KNOWN}) AND length(l) >= 5", "lower(substr(f, 1, 1)) || lower(l)", "l", "known_value")],
)
sweep_query(
    "sweep_certain_parts",
    pair_view("'candidate: ' || f || ' ' || l", "'met ' || upper(f) || ' ' || upper(l) || ' then ' || lower(f) || ' alone'"),
    ["FIELD_NAME"], ("exact", "part"),
    [
        (_NAMED, "upper(f) || ' ' || upper(l)", "f || ' ' || l", "established"),
        (_NAMED, "upper(f)", "f || ' ' || l", "established"),
        (f"{_NAMED} AND length(l) >= 3 AND lower(l) NOT IN ({_ASCII_STOP})", "upper(l)", "f || ' ' || l", "established"),
        (_NAMED, "lower(f)", "f || ' ' || l", "established"),
    ],
)
sweep_query(
    "sweep_allow",
    pair_view(_HEAD, "'file ' || f || '_' || l || '.x'"), ["LABEL_NAME"], ("full",),
    [("f || ' ' || l <> 'Jennifer Testcase' AND f || ' ' || l <> 'Thabo Testcase'", "f || '_' || l", "f || ' ' || l", "known_value")],
    CONFIG.with_(allow_terms=("Jennifer Testcase", " THABO testcase ")),
)

# whole documents, a session for each language: every name of a language is looked for in all its texts
_F, _L = pick("doc_id", V.FIRST), pick("cast(floor(doc_id / 2) as bigint)", V.LAST)
_SIGNED = f"""SELECT coalesce(lang, 'und') AS session_id, doc_id, coalesce(text, '') || ' ~ Name: ' || {_F} || ' ' || {_L} || '. Done; see https://x.org/in/' || lower({_F}) || '-' || lower({_L})
 || ' or ' || {_F} || '_' || {_L} || '; prose ' || lower({_F}) || ' ' || lower({_L}) || ' end' AS text, {_F} || ' ' || {_L} AS name, lower({_F}) || '-' || lower({_L}) AS slug, {_F} || '_' || {_L} AS joined FROM documents"""


@query(
    "sweep_documents",
    f"""WITH v AS ({_SIGNED}), p AS (SELECT session_id, doc_id, text, name, slug AS surface FROM v UNION ALL SELECT session_id, doc_id, text, name, joined FROM v)
SELECT session_id, doc_id, cast(strpos(text, surface) - 1 AS bigint) AS start_at, cast(strpos(text, surface) - 1 + length(surface) AS bigint) AS end_at,
 'PERSON' AS type, name AS value, surface, 'known_value' AS via FROM p""",
)
def sweep_documents(spark, folder):
    """Names learnt from labels at the foot of documents, found as slugs and joined names in whole texts of their language."""
    corpus = view(spark, folder, _SIGNED, *KEYS)
    found = materialize(detect(corpus, [LABELS["LABEL_NAME"]], KEYS, CONFIG))
    certain = W.certain_values(found, "session_id", CONFIG)
    known = W.known_values(W.upgrade(found, certain, "session_id"), certain, "session_id", CONFIG)
    return swept_out(W.sweep(corpus, found, known, KEYS, CONFIG, kinds=("full",)))


DISGUISED = "SELECT c_custkey AS session_id, cast(0 as bigint) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'get /f/u' || cast(c_custkey as string) || '%40acme.co.za/cv' WHEN 1 THEN 'u' || cast(c_custkey as string) || ' [at] acme [dot] org' ELSE 'plain u' || cast(c_custkey as string) END AS text FROM customer"


@query(
    "sweep_unmasked",
    "SELECT c_custkey AS session_id, 'u' || cast(c_custkey as string) || CASE c_custkey % 3 WHEN 0 THEN '@acme.co.za' ELSE '@acme.org' END AS value, 'EMAIL' AS type FROM customer WHERE c_custkey % 3 < 2",
)
def sweep_unmasked(spark, folder):
    """Addresses that exist only escaped or spelled out."""
    return W.disguised_values(view(spark, folder, DISGUISED, *KEYS), KEYS, Config.only("EMAIL"))


_SPANS = f"SELECT session_id, doc_id, start_at, start_at + length(value) AS end_at, value, type FROM ({findings_sql(SESSIONS)} SELECT * FROM f) q"


@query(
    "sweep_dedupe",
    f"""WITH seen AS ({_SPANS}), swept AS (SELECT session_id, doc_id, start_at + d AS start_at, end_at + d AS end_at, value, type, sure FROM ({_SPANS}) s, (VALUES (0, true), (0, false), (2, true), (2, false), (500, false)) AS t(d, sure))
SELECT * FROM swept w WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = w.session_id AND s.doc_id = w.doc_id
 AND CASE WHEN w.sure THEN w.start_at >= s.start_at AND w.end_at <= s.end_at ELSE w.start_at < s.end_at AND s.start_at < w.end_at END)""",
)
def sweep_dedupe(spark, folder):
    """Shifted copies of findings: kept only where no detection holds the ground."""
    rules = [BY_KEY[t] for t in ("EMAIL", "IPV4", "CREDIT_CARD")]
    found = detect(view(spark, folder, SESSIONS, *KEYS), rules, KEYS)
    moves = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("sure")) for d, s in ((0, True), (0, False), (2, True), (2, False), (500, False))])
    swept = found.select(*KEYS, "start_at", "end_at", "value", "type", F.explode(moves).alias("m")).select(
        *KEYS, (F.col("start_at") + F.col("m.d")).alias("start_at"), (F.col("end_at") + F.col("m.d")).alias("end_at"), "value", "type", F.col("m.sure").alias("sure")
    )
    kept = W.uncovered(swept, found, KEYS)
    return kept.withColumn("start_at", F.col("start_at").cast("bigint")).withColumn("end_at", F.col("end_at").cast("bigint"))


# what addresses, paths and file names are, written for an engine without lookbehind
_URL = r"(?i)(?:[a-z][a-z0-9+.-]*://|www\.)[^\s\"'<>]+|/[A-Za-z0-9._~%\-/]{3,}|[A-Za-z0-9._~%-]+\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|rtf|zip|png|jpe?g|gif|html?)\>"
_ZONES = "SELECT page_id AS doc_id, url || ' ' || html AS text FROM pages"


@query(
    "url_zones",
    matches_sql(_ZONES, re2(_URL)) + " SELECT doc_id, start_at, start_at + length(value) AS end_at, value FROM e",
)
def url_zones(spark, folder):
    texts = view(spark, folder, _ZONES)
    found = find_spans(texts, [Rule("URL", W.URLISH, "i")], ["doc_id"], context=0)
    return found.select("doc_id", F.col("start_at").cast("bigint").alias("start_at"), F.col("end_at").cast("bigint").alias("end_at"), "value")
