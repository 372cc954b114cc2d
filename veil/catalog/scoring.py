"""Grading, filters, overlaps and hidden forms."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import EMAIL_RE2, luhn_sql, matches_sql, pad, query, quoted, re2, spans_out, view
from veil.catalog.detectors import BY_KEY, DIGITS, ONLY_DIGITS
from veil.config import Config, resolve_detectors
from veil.operators import rules as R
from veil.operators import score as S
from veil.operators.detect import detect
from veil.operators.encoded import detect_encoded, drop_in_base64
from veil.functions.text import unmarked
from veil.operators.inrow import detection, finding_rows, resolved
from veil.operators.resolve import (
    TYPE_PRECEDENCE, above_floor, drop_allowed, drop_rejected, enough_instances, precedence, resolve_overlaps,
)

# ---- SQL for grading one row per finding: doc_id, text, start_at, value, type, via
_BASE = "CASE via " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.BASE.items()) + " END"
_HOT = "CASE type " + " ".join(f"WHEN '{t}' THEN [{quoted(w.split())}]" for t, w in S.HOTWORDS.items()) + " ELSE [] END"
_NUMERIC = quoted(S.NUMERIC_TYPES)


def scored_sql(findings: str) -> str:
    """CTEs over a ``WITH ...`` prefix ending in relation ``f``; relation ``g`` carries the grades."""
    return findings + f""", c1 AS (SELECT *, substr(text, cast(greatest(start_at - 42, 0) AS int) + 1, cast(least(start_at, 42) AS int)) AS bef, substr(text, cast(start_at + length(value) AS int) + 1, 42) AS aft FROM f),
c2 AS (SELECT *, list_concat(regexp_extract_all(lower(bef), '[a-z][a-z''-]*'), regexp_extract_all(lower(aft), '[a-z][a-z''-]*')) AS near,
 regexp_extract_all(lower(right(bef, 16)), '[a-z][a-z''-]*') AS tail, {_HOT} AS hots FROM c1),
c3 AS (SELECT *, list_filter(hots, lambda w: list_contains(near, w))[1] AS hotword,
 CASE WHEN type IN ({_NUMERIC}) AND via NOT IN ('established', 'term') AND tail[len(tail)] IN ({quoted(S.ANTIWORDS)}) THEN tail[len(tail)] END AS antiword,
 type = 'PERSON' AND via NOT IN ('established', 'term') AND value = lower(value) AS low FROM c2),
g AS (SELECT *, greatest(0, least(99, {_BASE} + CASE WHEN hotword IS NULL THEN 0 ELSE 15 END - CASE WHEN antiword IS NULL THEN 0 ELSE 45 END - CASE WHEN low THEN 20 ELSE 0 END)) AS points FROM c3)"""


LEVEL_SQL = "CASE WHEN points >= 85 THEN 'high' WHEN points >= 60 THEN 'medium' ELSE 'low' END"
# phone-like and card-like numbers after short phrases
NUMBERS = f"""WITH v AS ({V.CONTEXT}),
f AS (SELECT doc_id, text, cast(strpos(text, num) - 1 AS bigint) AS start_at, num AS value, CASE WHEN length(num) = 10 THEN 'PHONE' ELSE 'CREDIT_CARD' END AS type,
 CASE WHEN length(num) = 10 THEN 'shape' ELSE 'checksum' END AS via FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]{{10,16}}') AS num FROM v)
 WHERE length(num) = 10 OR {luhn_sql('num')})"""


def numbers(spark, folder):
    return detect(view(spark, folder, V.CONTEXT), [BY_KEY["PHONE"], BY_KEY["CREDIT_CARD"]], ["doc_id"])


_IDS_SQL = (
    matches_sql(V.IDS, r"\b\d{6}[ \x{a0}.\-/]?\d{4}[ \x{a0}.\-/]?\d{2}[ \x{a0}.\-/]?\d\b")
    + f""", f AS (SELECT doc_id, text, start_at, value, 'SA_ID' AS type, CASE WHEN {luhn_sql(DIGITS)} THEN 'checksum' ELSE 'sa_id_weak' END AS via FROM e
 WHERE cast(substr({DIGITS}, 3, 2) AS int) BETWEEN 1 AND 12 AND cast(substr({DIGITS}, 5, 2) AS int) BETWEEN 1 AND 31 AND substr({DIGITS}, 11, 1) IN ('0', '1'))"""
)


@query("score_base", _IDS_SQL + f" SELECT doc_id, value, via, {_BASE} / 100.0 AS base FROM f")
def score_base(spark, folder):
    found = detect(view(spark, folder, V.IDS), [BY_KEY["SA_ID"]], ["doc_id"])
    return found.select("doc_id", "value", "via", (S.base_score(F.col("via")) / 100.0).alias("base"))


@query("score_hotword", scored_sql(NUMBERS) + " SELECT doc_id, type, value, hotword FROM g")
def score_hotword(spark, folder):
    return numbers(spark, folder).select("doc_id", "type", "value", S.hotword(F.col("type"), F.col("before"), F.col("after")).alias("hotword"))


@query("score_antiword", scored_sql(NUMBERS) + " SELECT doc_id, type, value, antiword FROM g")
def score_antiword(spark, folder):
    return numbers(spark, folder).select("doc_id", "type", "value", S.antiword(F.col("type"), F.col("via"), F.col("before")).alias("antiword"))


LOW_VIEW = f"SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'Name: jane doe' WHEN 1 THEN 'Name: Jane Doe' ELSE 'name: jane ' || cast(c_custkey as string) END AS text FROM customer"


@query(
    "score_lowercase_person",
    f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'jane doe' WHEN 1 THEN 'Jane Doe' ELSE 'jane' END AS value, doc_id % 3 <> 1 AS lowercase FROM ({LOW_VIEW})",
)
def score_lowercase_person(spark, folder):
    from veil.operators.labels import label_rules

    found = detect(view(spark, folder, LOW_VIEW), label_rules()[:1], ["doc_id"])
    return found.select("doc_id", "value", S.is_lowercase_person(F.col("type"), F.col("via"), F.col("value")).alias("lowercase"))


_REASON = """CASE type WHEN 'PHONE' THEN 'Digits shaped like a phone number' ELSE 'Luhn-valid card number' END
 || CASE WHEN hotword IS NULL THEN '' ELSE ', "' || hotword || '" appears next to it' END
 || CASE WHEN antiword IS NULL THEN '' ELSE ', but "' || antiword || '" immediately precedes it, which usually labels a transactional number' END"""


@query(
    "score_floor_level",
    scored_sql(NUMBERS) + f" SELECT doc_id, type, value, points / 100.0 AS confidence, {LEVEL_SQL} AS level, {_REASON} AS reason FROM g WHERE points >= 35",
)
def score_floor_level(spark, folder):
    return S.score(numbers(spark, folder)).select("doc_id", "type", "value", "confidence", "level", "reason")


# What is said of a type where no single match is at hand.
CATALOG = {
    "EMAIL": ("high", 0.98, "Email address format"), "CREDIT_CARD": ("high", 0.98, "Luhn-valid card number"),
    "SA_ID": ("high", 0.97, "Luhn-valid 13-digit South African ID with a valid date"),
    "SA_ID_WEAK": ("medium", 0.72, "13-digit South African ID shape and a valid date, but the check digit does not match - mistyped or synthetic"),
    "AADHAAR": ("high", 0.97, "Verhoeff-checked Aadhaar number"), "SSN": ("high", 0.93, "US Social Security number format"),
    "IBAN": ("high", 0.95, "IBAN country + check-digit structure"), "IPV4": ("high", 0.93, "IPv4 address"), "IPV6": ("high", 0.93, "IPv6 address"),
    "MAC": ("high", 0.95, "MAC address"), "PAN_INDIA": ("high", 0.95, "Indian PAN structure (AAAAA1234A)"),
    "NINO_UK": ("high", 0.94, "UK National Insurance number with a valid prefix"), "ETH_ADDRESS": ("high", 0.97, "Ethereum address (0x + 40 hex)"),
    "BTC_ADDRESS": ("high", 0.95, "Bitcoin address format"), "DOB": ("high", 0.92, "Date next to a date-of-birth label"),
    "ID": ("high", 0.90, "Value next to a personal-identifier label"), "CUSTOM": ("high", 0.99, "Matched one of your always-mask terms"),
    "API_KEY": ("high", 0.99, "Provider-issued API key format"), "PRIVATE_KEY": ("high", 0.99, "Private key block"),
    "SEED_PHRASE": ("high", 0.98, "Wallet recovery phrase (BIP-39 word shape)"), "JWT": ("high", 0.97, "JSON Web Token structure"),
    "CONNECTION_STRING": ("high", 0.97, "Connection URI with an inline password"), "SECRET": ("high", 0.90, "Value assigned to a credential-named field"),
    "VIN": ("medium", 0.75, "17-character VIN structure (letters + digits, no I/O/Q)"), "PHONE": ("medium", 0.75, "Phone-number shape"),
    "STREET_ADDRESS": ("medium", 0.70, "Street number followed by a named street and a street type"),
    "PERSON": ("medium", 0.70, "Known first name followed by a capitalised surname (or an honorific)"),
}
_TYPES = "SELECT DISTINCT upper(event_type) AS type FROM events UNION SELECT DISTINCT CASE WHEN contains(text, '@') THEN 'EMAIL' WHEN contains(text, 'token =') THEN 'SECRET' ELSE 'PHONE' END FROM documents"
_CAT_SQL = " UNION ALL ".join(f"SELECT '{k}' AS type, '{lv}' AS level, {sc:.2f} AS score, '{why}' AS reason" for k, (lv, sc, why) in CATALOG.items())


@query(
    "confidence_catalog",
    f"""SELECT t.type, coalesce(c.level, 'high') AS level, cast(coalesce(c.score, 0.96) AS double) AS score,
 coalesce(c.reason, 'Matched your custom "' || t.type || '" pattern') AS reason FROM ({_TYPES}) t LEFT JOIN ({_CAT_SQL}) c ON c.type = t.type""",
)
def confidence_catalog(spark, folder):
    kinds = view(spark, folder, _TYPES, "type")
    listed = spark.createDataFrame([(k, *v) for k, v in CATALOG.items()], "type string, level string, score double, reason string")
    return kinds.join(F.broadcast(listed), "type", "left").select(
        "type", F.coalesce("level", F.lit("high")).alias("level"), F.coalesce("score", F.lit(0.96)).alias("score"),
        F.coalesce("reason", F.concat(F.lit('Matched your custom "'), "type", F.lit('" pattern'))).alias("reason"),
    )


# ---- filters
EMAILS_SQL = matches_sql(V.DOCS, EMAIL_RE2) + ", f AS (SELECT *, 'EMAIL' AS type, 'structural' AS via FROM e)"
FILTER_OUT = "SELECT doc_id, start_at, start_at + length(value) AS end_at, 'EMAIL' AS type, value, 'structural' AS via FROM f"


def emails(spark, folder):
    return detect(view(spark, folder, V.DOCS), [BY_KEY["EMAIL"]], ["doc_id"])


@query("flt_allow", EMAILS_SQL + ", a AS (SELECT DISTINCT lower(value) AS v FROM e WHERE contains(value, 'mail2.') OR contains(value, 'mail5.')) " + FILTER_OUT + " WHERE lower(value) NOT IN (SELECT v FROM a)")
def flt_allow(spark, folder):
    """The allow list is a table: addresses of two hosts."""
    found = emails(spark, folder)
    allow = found.where(F.contains("value", F.lit("mail2.")) | F.contains("value", F.lit("mail5."))).select("value")
    return spans_out(drop_allowed(found, allow))


@query("flt_reject", EMAILS_SQL + " " + FILTER_OUT + " WHERE NOT starts_with(value, 'e') AND NOT starts_with(value, 't')")
def flt_reject(spark, folder):
    found = emails(spark, folder).withColumn("finding_id", S.finding_id(F.col("type"), F.col("value")))
    rejected = found.where(F.col("value").startswith("e") | F.col("value").startswith("t")).select("finding_id", "value")
    return spans_out(drop_rejected(found, rejected))


@query("flt_min_conf", scored_sql(NUMBERS) + f" SELECT doc_id, type, value, {LEVEL_SQL} AS level FROM g WHERE points >= 95")
def flt_min_conf(spark, folder):
    """The floor named high is 0.95, above where the label high starts."""
    floor = Config(min_confidence_level="high").confidence_floor
    return above_floor(S.score(numbers(spark, folder)), floor).select("doc_id", "type", "value", "level")


CARDS_SQL = matches_sql(V.CARDS, r"\b\d(?:[ \-]?\d){12,18}\b", search=ONLY_DIGITS) + f", f AS (SELECT doc_id, text, start_at, value, 'CREDIT_CARD' AS type, 'checksum' AS via FROM e WHERE length({DIGITS}) BETWEEN 13 AND 19 AND {luhn_sql(DIGITS)})"


@query(
    "flt_instance",
    CARDS_SQL + " SELECT doc_id, start_at, start_at + length(value) AS end_at, type, value, via FROM f QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2",
)
def flt_instance(spark, folder):
    found = detect(view(spark, folder, V.CARDS), [BY_KEY["CREDIT_CARD"]], ["doc_id"])
    return spans_out(enough_instances(found, ["doc_id"], {"CREDIT_CARD": 2}))


@query(
    "flt_detectors",
    matches_sql(V.IDS, re2(R.SSN)) + f""" SELECT 'code' AS profile, 'SSN' AS type, count(*) AS hits FROM e
UNION ALL SELECT 'strict', 'SSN', count(*) FROM e UNION ALL SELECT 'strict', 'MAC', count(*) FROM (SELECT unnest(regexp_extract_all(text, '(?i){re2(R.MAC)}')) FROM v)
UNION ALL SELECT 'explicit', 'MAC', count(*) FROM (SELECT unnest(regexp_extract_all(text, '(?i){re2(R.MAC)}')) FROM v)""",
)
def flt_detectors(spark, folder):
    """SSN and MAC under two profiles and an explicit list; rules switched off never enter the plan."""
    texts = view(spark, folder, V.IDS)
    chosen = {"code": resolve_detectors("code"), "strict": resolve_detectors("strict"), "explicit": resolve_detectors(explicit=["mac"])}
    tried = [r for r in R.BUILTIN if r.key in ("SSN", "MAC")]
    found = detect(texts, tried, ["doc_id"])
    allowed = F.array(*[
        F.struct(F.lit(p).alias("profile"), F.lit(t).alias("type")) for p, flags in chosen.items() for t in ("SSN", "MAC") if flags.get(t, False)
    ])
    return (
        found.groupBy("type").agg(F.count(F.lit(1)).alias("hits")).withColumn("p", F.explode(F.filter(allowed, lambda a: a["type"] == F.col("type"))))
        .select("p.profile", "type", "hits")
    )


_PREC = "CASE type " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in TYPE_PRECEDENCE.items()) + " ELSE 0 END"
_KIND_VIEW = "SELECT o_orderkey AS doc_id, " + \
    "CASE o_orderkey % 6 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'ID' WHEN 3 THEN 'PERSON' WHEN 4 THEN 'LITERAL' ELSE 'GPS' END AS type, " + \
    "CASE cast(floor(o_orderkey / 6) as bigint) % 6 WHEN 0 THEN 'shape' WHEN 1 THEN 'label' WHEN 2 THEN 'custom' WHEN 3 THEN 'token_literal' WHEN 4 THEN 'established' ELSE 'field' END AS via, o_custkey % 5 = 0 AS swept FROM orders"


@query(
    "precedence",
    f"""SELECT doc_id, type, via, swept, cast(CASE WHEN via = 'token_literal' THEN 200 WHEN via = 'custom' THEN greatest({_PREC}, 105) WHEN swept THEN 1
 WHEN via IN ('label', 'field') THEN greatest({_PREC}, 70) ELSE {_PREC} END AS bigint) AS rank FROM ({_KIND_VIEW})""",
)
def precedence_rank(spark, folder):
    rank = precedence(F.col("type"), F.col("via"), F.col("swept")).cast("bigint")
    return view(spark, folder, _KIND_VIEW).withColumn("rank", rank)


_RESOLVE_TYPES = ["SSN", "IPV4", "PAN_INDIA", "ETH_ADDRESS", "STREET_ADDRESS", "MAC", "VIN"]
_CANDIDATES = " UNION ALL ".join(
    f"SELECT doc_id, start_at, value, '{t}' AS type FROM ({matches_sql(V.IDS, ('(?i)' if t in ('MAC', 'VIN') else '') + re2(getattr(R, t)))} SELECT * FROM e) q"
    + (" WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')" if t == "VIN" else "")
    for t in _RESOLVE_TYPES
) + " UNION ALL SELECT doc_id, start_at, value, 'CUSTOM' FROM (" + matches_sql(V.IDS, r"[0-9-]{4,8}") + " SELECT * FROM e) q"


_RESOLVED = (
    f"""WITH RECURSIVE cand AS ({_CANDIDATES}),
o AS (SELECT *, start_at + length(value) AS end_at, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, {_PREC.replace("'CUSTOM' THEN 55", "'CUSTOM' THEN 105")} DESC, length(value) DESC) AS rn FROM cand),
walk AS (SELECT doc_id, rn, end_at AS last_end, true AS kept FROM o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.start_at >= w.last_end THEN o.end_at ELSE w.last_end END, o.start_at >= w.last_end FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
SELECT o.doc_id, o.start_at, o.end_at, o.type, o.value FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn WHERE kept"""
)


def _resolving(spark):
    chosen = [r for r in R.BUILTIN if r.key in _RESOLVE_TYPES]
    return chosen + R.custom_rules(Config(custom_patterns=({"type": "CUSTOM", "pattern": "[0-9-]{4,8}"},)), spark)


@query("resolve_overlaps", _RESOLVED)
def resolve(spark, folder):
    found = detect(view(spark, folder, V.IDS), _resolving(spark), ["doc_id"], context=0)  # nothing is graded
    return spans_out(resolve_overlaps(found, ["doc_id"])).drop("via")


@query("resolve_in_row", _RESOLVED)
def resolve_in_row(spark, folder):
    """The same inside the row: candidates and walk as arrays, nothing shuffled."""
    texts = view(spark, folder, V.IDS).select("doc_id", unmarked(F.col("text")).alias("_body"))
    for step in [*detection(F.col("_body"), _resolving(spark), Config(), context=0), resolved]:
        texts = texts.withColumn("_found", step(F.col("_found")))
    return spans_out(finding_rows(texts, ["doc_id"], "_found")).drop("via")


# ---- hidden forms
ENCODED = f"""SELECT c_custkey AS doc_id, c_name || ' says ' || CASE c_custkey % 4 WHEN 0 THEN 'to=u' || cast(c_custkey as string) || '.x%40mail.example.com&k=1' WHEN 1 THEN 'phone=%2B2782' || {pad('c_custkey', 7)} || ' ok'
 WHEN 2 THEN 'u' || cast(c_custkey as string) || '&#64;mail.example.com now' ELSE '100%25 sure, 50%zz' END AS text FROM customer"""


_REGION_SQL = (
    matches_sql(ENCODED, r"[A-Za-z0-9%+._~@-]*(?:%[0-9A-Fa-f]{2}|&#\d{2,4};)[A-Za-z0-9%+._~@;#&-]*")
    + ", d AS (SELECT *, url_decode(replace(replace(value, '&#64;', '@'), '+', '%2B')) AS decoded FROM e WHERE NOT contains(value, '%zz'))"
)


@query(
    "enc_percent_entity",
    _REGION_SQL
    + f""" SELECT doc_id, start_at, start_at + length(value) AS end_at,
 CASE WHEN regexp_matches(decoded, '{EMAIL_RE2}') THEN 'EMAIL' ELSE 'PHONE' END AS type, decoded AS value, 'structural' AS via FROM d
 WHERE decoded <> value AND (regexp_matches(decoded, '{EMAIL_RE2}') OR regexp_matches(decoded, '\\+27\\d{{9}}'))""",
)
def enc_percent_entity(spark, folder):
    return spans_out(detect_encoded(view(spark, folder, ENCODED), ["doc_id"], Config(), spark, kinds=("ESCAPED",)))


SPELLED = f"SELECT c_custkey AS doc_id, 'write to u' || cast(c_custkey as string) || CASE c_custkey % 4 WHEN 0 THEN ' [at] mail [dot] example [dot] com' WHEN 1 THEN ' at mail dot example dot com' WHEN 2 THEN '(AT)mail(DOT)org' ELSE ' at the dotted line' END || ' ~ ' || c_mktsegment AS text FROM customer"


@query(
    "enc_at_dot",
    f"""SELECT doc_id, cast(9 AS bigint) AS start_at, cast(strpos(text, ' ~ ') - 1 AS bigint) AS end_at, 'EMAIL' AS type,
 'u' || cast(doc_id AS string) || CASE doc_id % 4 WHEN 2 THEN '@mail.org' ELSE '@mail.example.com' END AS value, 'structural' AS via FROM ({SPELLED}) WHERE doc_id % 4 < 3""",
)
def enc_at_dot(spark, folder):
    return spans_out(detect_encoded(view(spark, folder, SPELLED), ["doc_id"], Config(), spark, kinds=("SPELLED",)))


_HEX_TEXT = "'user u' || cast(c_custkey as string) || '@mail.example.com lives in ' || cast(c_nationkey as string)"


@query(
    "enc_base64",
    f"""WITH v AS (SELECT c_custkey AS doc_id, to_base64(encode(CASE WHEN c_custkey % 3 = 0 THEN 'nothing of note in this line of text' ELSE {_HEX_TEXT} END)) AS b FROM customer)
SELECT doc_id, cast(6 AS bigint) AS start_at, cast(6 + length(b) AS bigint) AS end_at, 'SECRET' AS type, b AS value, 'structural' AS via FROM v WHERE doc_id % 3 <> 0""",
)
def enc_base64(spark, folder):
    base = view(spark, folder, f"SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'nothing of note in this line of text' ELSE {_HEX_TEXT} END AS plain FROM customer")
    texts = base.select("doc_id", F.concat(F.lit("blob: "), F.base64(F.encode("plain", "UTF-8")), F.lit(" end")).alias("text"))
    return spans_out(detect_encoded(texts, ["doc_id"], Config(), spark, kinds=("BASE64",)))


BLOBS = f"""SELECT doc_id, text || ' ~ ' || repeat('Ab9/', 20) || '1HGCM82633A' || {pad('doc_id', 6)} || repeat('xY8+', 6) || ' ~ 1HGCM82633B' || {pad('doc_id', 6)} || ' ~ ' || repeat('q', 70) || '/' || {pad('doc_id', 10)} || '/abc' AS text FROM documents"""
_VIN_PHONE = f"""SELECT doc_id, start_at, value, 'VIN' AS type FROM ({matches_sql(BLOBS, "(?i)" + re2(R.VIN))} SELECT * FROM e) q WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
 UNION ALL SELECT doc_id, start_at, value, 'SSN' FROM ({matches_sql(BLOBS, re2(R.SSN))} SELECT * FROM e) q
 UNION ALL SELECT doc_id, start_at, value, 'IPV4' FROM ({matches_sql(BLOBS, re2(R.IPV4))} SELECT * FROM e) q"""


@query(
    "drop_in_b64",
    f"""WITH x AS ({_VIN_PHONE}), runs AS (SELECT doc_id, start_at AS a, start_at + length(value) AS b FROM ({matches_sql(BLOBS, "[A-Za-z0-9+/]{64,}={0,2}")} SELECT * FROM e) q)
SELECT doc_id, start_at, start_at + length(value) AS end_at, type, value, 'shape' AS via FROM x
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.start_at >= r.a AND x.start_at + length(x.value) <= r.b)""",
)
def drop_in_b64(spark, folder):
    texts = view(spark, folder, BLOBS)
    found = detect(texts, [BY_KEY["VIN"], BY_KEY["SSN"], BY_KEY["IPV4"]], ["doc_id"])
    return spans_out(drop_in_base64(found, texts, ["doc_id"]))
