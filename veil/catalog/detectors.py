"""Value and credential detectors, each over whole texts."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import CONNECTION_RE2, EMAIL_RE2, PRIVATE_KEY_RE2, luhn_sql, matches_sql, query, quoted, re2, spans_out, spans_sql, view
from veil.config import Config
from veil.functions.text import norm
from veil.operators import rules as R
from veil.operators.detect import detect
from veil.operators.secrets import seed_phrases
from veil.operators.terms import detect_terms

BY_KEY = {r.key: r for r in R.BUILTIN + R.SECRETS}


def detector(name: str, key: str, sql: str, pattern: str, via: str, valid: str = "true", type_: str | None = None, **kw) -> None:
    oracle = spans_sql(sql, pattern, f"'{type_ or key}'", via, valid, **kw)

    @query(name, oracle)
    def run(spark, folder):
        return spans_out(detect(view(spark, folder, sql), [BY_KEY[key]], ["doc_id"]))


DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
# letters and punctuation blanked, so that a word border is a digit border
ONLY_DIGITS = "regexp_replace(text, '[^0-9 \\-]', '#', 'g')"

detector("det_email", "EMAIL", V.DOCS, EMAIL_RE2, "'structural'")
detector(
    "det_credit_card", "CREDIT_CARD", V.CARDS, r"\b\d(?:[ \-]?\d){12,18}\b", "'checksum'",
    f"length({DIGITS}) BETWEEN 13 AND 19 AND {luhn_sql(DIGITS)}", search=ONLY_DIGITS,
)
detector(
    "det_sa_id", "SA_ID", V.IDS, r"\b\d{6}[ \x{a0}.\-/]?\d{4}[ \x{a0}.\-/]?\d{2}[ \x{a0}.\-/]?\d\b",
    f"CASE WHEN {luhn_sql(DIGITS)} THEN 'checksum' ELSE 'sa_id_weak' END",
    f"cast(substr({DIGITS}, 3, 2) AS int) BETWEEN 1 AND 12 AND cast(substr({DIGITS}, 5, 2) AS int) BETWEEN 1 AND 31 "
    f"AND substr({DIGITS}, 11, 1) IN ('0', '1')",
)
detector("det_ssn", "SSN", V.IDS, re2(R.SSN), "'shape'")
_SEP = r"[ \x{a0}\-.]"
detector(
    "det_phone", "PHONE", V.IDS,
    rf"(^|[^A-Za-z0-9_])((?:\+\d{{1,3}}{_SEP}?)?(?:\(\d{{1,4}}\){_SEP}?|\d{{1,4}}{_SEP})?\d{{2,6}}(?:{_SEP}\d{{2,6}}){{1,4}})\b"
    rf"|(^|[^A-Za-z0-9_.])(\+\d{{1,3}}(?:{_SEP}?\d{{1,9}}){{1,4}})\b|(^|[^A-Za-z0-9_.])(\+\d{{9,14}})\b|(^|[^A-Za-z0-9_.])(\d{{9,11}})\b",
    "'shape'",
    f"""length({DIGITS}) BETWEEN 7 AND 15
 AND NOT regexp_matches(value, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}$|^\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{2,4}}$')
 AND NOT regexp_full_match(value, '\\d{{4}}(?:[ .-]+\\d{{4}})+')
 AND (starts_with(value, '+') OR regexp_matches(value, '[()]') OR starts_with({DIGITS}, '0') OR regexp_matches(value, '[ .-]') OR length({DIGITS}) >= 10)""",
    groups=8, lead="concat(g1[i], g3[i], g5[i], g7[i])", value="concat(g2[i], g4[i], g6[i], g8[i])",
)
detector("det_ipv4", "IPV4", V.DOCS, re2(R.IPV4), "'shape'")
_MOD97 = (
    "list_reduce(list_prepend(0, list_transform(range(1, length(b) + 1), lambda i: "
    "CASE WHEN substr(b, i, 1) BETWEEN 'A' AND 'Z' THEN 100 + ascii(substr(b, i, 1)) - 55 ELSE cast(substr(b, i, 1) AS int) END)), "
    "lambda r, c: CASE WHEN c >= 100 THEN (r * 100 + c - 100) % 97 ELSE (r * 10 + c) % 97 END)"
)


@query(
    "det_iban",
    matches_sql(
        V.IBANS, r"(^|[^A-Z0-9])([A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?:[^A-Z0-9]|$)"
        r"|(^|[^A-Z0-9])([A-Z]{2}\d{2}[A-Z0-9]{11,30})(?:[^A-Z0-9]|$)",
        groups=4, lead="concat(g1[i], g3[i])", value="concat(g2[i], g4[i])",
    )
    + f""", r AS (SELECT *, replace(value, ' ', '') AS t, concat(substr(replace(value, ' ', ''), 5), substr(replace(value, ' ', ''), 1, 4)) AS b FROM e)
SELECT doc_id, start_at, start_at + length(value) AS end_at, 'IBAN' AS type, value,
 CASE WHEN {_MOD97} = 1 THEN 'checksum' ELSE 'shape' END AS via FROM r WHERE length(t) BETWEEN 15 AND 34""",
)
def det_iban(spark, folder):
    return spans_out(detect(view(spark, folder, V.IBANS), [BY_KEY["IBAN"]], ["doc_id"]))


_COLONS = "(length(value) - length(replace(value, ':', '')))"
detector(
    "det_ipv6", "IPV6", V.IDS, "(?i)" + re2(R.IPV6), "'structural'",
    f"NOT ({_COLONS} <= 2 AND regexp_full_match(value, '\\d{{1,2}}(:\\d{{1,2}}){{1,2}}')) AND (contains(value, '::') OR {_COLONS} >= 4)",
)
detector("det_mac", "MAC", V.IDS, "(?i)" + re2(R.MAC), "'structural'")
detector("det_vin", "VIN", V.IDS, "(?i)" + re2(R.VIN), "'shape'", "regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')")
detector("det_pan_india", "PAN_INDIA", V.IDS, re2(R.PAN_INDIA), "'structural'")
detector("det_nino_uk", "NINO_UK", V.IDS, re2(R.NINO_UK), "'checksum'", "substr(value, 1, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')")
_D = "'0123456789123406789523401789563401289567401239567859876043216598710432765982104387659321049876543210'"
_P = "'01234567891576283094580379614289160435279453126870428657390127938064157046913258'"
detector(
    # a number is judged as the whole run of digit groups it belongs to
    "det_aadhaar", "AADHAAR", V.IDS, r"\b\d+(?:[ \-.]\d+)*\b", "'checksum'",
    f"""regexp_full_match(value, '[2-9]\\d{{3}} \\d{{4}} \\d{{4}}')
 AND NOT list_bool_and(list_transform(string_split(value, ' '), lambda g: cast(g AS bigint) BETWEEN 1900 AND 2099))
 AND list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i:
   cast(substr({_P}, (i % 8) * 10 + 1 + cast(substr(reverse({DIGITS}), i + 1, 1) AS int), 1) AS int))),
   lambda c, p: cast(substr({_D}, c * 10 + p + 1, 1) AS int)) = 0""",
)
detector("det_eth", "ETH_ADDRESS", V.IDS, re2(R.ETH_ADDRESS), "'structural'")
detector("det_btc", "BTC_ADDRESS", V.IDS, re2(R.BTC_ADDRESS), "'structural'")
detector("det_po_box", "PO_BOX", V.IDS, "(?i)" + re2(R.PO_BOX), "'shape'", type_="STREET_ADDRESS")
detector(
    "det_gps", "GPS", V.IDS,
    r"(^|[^0-9.])(-?(?:[0-8]?\d|90)\.\d{3,8}\s*,\s*-?(?:1[0-7]\d|[0-9]?\d)\.\d{3,8})(?:[^0-9.]|$)", "'shape'",
    groups=2, lead="g1[i]", value="g2[i]",
)
detector("det_street", "STREET_ADDRESS", V.IDS, re2(R.STREET_ADDRESS), "'shape'")

TERMS = ["project", "thinhe", "ération", "the eater", "mail5.example.com"]


@query("det_custom_terms", spans_sql(V.DOCS, r"(?i)\b(?:mail5\.example\.com|the eater|project|thinhe)\b", "'CUSTOM'", "'term'"))
def det_custom_terms(spark, folder):
    config = Config.only(custom_terms=tuple(t for t in TERMS if t.isascii()))
    return spans_out(detect(view(spark, folder, V.DOCS), R.term_rule(config), ["doc_id"]))


@query(
    "det_custom_terms_table",
    """WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part), v AS (SELECT o_orderkey AS doc_id,
 'shipped the ' || upper(p_name) || ' with priority ' || o_orderpriority AS text, p_name FROM orders JOIN part ON p_partkey = o_custkey)
SELECT doc_id, cast(12 AS bigint) AS start_at, cast(12 + length(p_name) AS bigint) AS end_at, 'CUSTOM' AS type, upper(p_name) AS value, 'term' AS via
FROM v JOIN t ON lower(p_name) = term""",
)
def det_custom_terms_table(spark, folder):
    texts = view(
        spark, folder,
        "SELECT o_orderkey AS doc_id, 'shipped the ' || upper(p_name) || ' with priority ' || o_orderpriority AS text "
        "FROM orders JOIN part ON p_partkey = o_custkey",
    )
    return spans_out(detect_terms(texts, spark.table("part").select("p_name"), ["doc_id"]))


@query("det_custom_patterns", spans_sql(V.DOCS, r"mail\d\.example\.com", "'MAIL_HOST'", "'custom'"))
def det_custom_patterns(spark, folder):
    patterns = ({"type": "MAIL_HOST", "pattern": r"mail\d\.example\.com"}, {"name": "BROKEN", "regex": "(unclosed"})
    return spans_out(detect(view(spark, folder, V.DOCS), R.custom_rules(Config.only(custom_patterns=patterns), spark), ["doc_id"]))


@query("det_token_lookalike", spans_sql(V.IDS, r"\[[A-Z][A-Z0-9_]*_\d+\]", "'LITERAL'", "'token_literal'"))
def det_token_lookalike(spark, folder):
    return spans_out(detect(view(spark, folder, V.IDS), R.lookalike_rule(Config()), ["doc_id"]))


@query(
    "det_prevalence",
    matches_sql(V.DOCS, EMAIL_RE2)
    + """ SELECT 'EMAIL' AS type, count(DISTINCT doc_id) AS texts, count(*) AS hits, count(DISTINCT lower(value)) AS distinct_values FROM e
UNION ALL SELECT 'IPV4', count(DISTINCT doc_id), count(*), count(DISTINCT h) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"""
    + re2(R.IPV4)
    + """')) AS h FROM documents)""",
)
def det_prevalence(spark, folder):
    """How widespread each type is: texts hit, hits, distinct values."""
    found = detect(view(spark, folder, V.DOCS), [BY_KEY["EMAIL"], BY_KEY["IPV4"]], ["doc_id"])
    return found.groupBy("type").agg(
        F.countDistinct("doc_id").alias("texts"), F.count(F.lit(1)).alias("hits"), F.countDistinct(norm(F.col("value"))).alias("distinct_values")
    )


# ---- credentials
detector(
    "sec_api_key", "API_KEY", V.SECRETS,
    r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35})(?:[^A-Za-z0-9_-]|$)", "'secret'", groups=1, value="g1[i]",
)
detector("sec_private_key", "PRIVATE_KEY", V.SECRETS, PRIVATE_KEY_RE2, "'secret'")


@query(
    "sec_jwt",
    spans_sql(
        V.SECRETS, r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})(?:[^A-Za-z0-9_-]|$)", "'JWT'", "'secret'",
        "json_valid(decode(from_base64(rpad(translate(string_split(value, '.')[1], '-_', '+/'), cast(ceil(length(string_split(value, '.')[1]) / 4.0) * 4 AS int), '='))))",
        groups=1, value="g1[i]",
    ),
)
def sec_jwt(spark, folder):
    return spans_out(detect(view(spark, folder, V.SECRETS), [BY_KEY["JWT"]], ["doc_id"]))


detector("sec_conn_string", "CONNECTION_STRING", V.SECRETS, "(?i)" + CONNECTION_RE2, "'secret'")
detector(
    "sec_labelled", "SECRET", V.SECRETS,
    "(?i)(^|[^A-Za-z0-9])((?:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?token)"
    r"(?:\"|''|&quot;)?\s*[:=]\s*(?:\"|''|&quot;)?)([A-Za-z0-9+/_.~!@#$%^*=-]{8,})",
    "'secret'", "regexp_matches(value, '[0-9]|[^A-Za-z]')", groups=3, lead="concat(g1[i], g2[i])", value="g3[i]",
)

# the word list is a parameter; here it is the vocabulary of part names
_SEED_WORDS = """SELECT o_custkey, o_orderkey, {first_word} AS word FROM orders JOIN part ON p_partkey = o_orderkey % 200"""


@query(
    "sec_seed_phrase",
    f"""WITH w AS ({_SEED_WORDS.format(first_word="string_split(p_name, ' ')[1]")}),
v AS (SELECT o_custkey AS doc_id, string_agg(word, ' ' ORDER BY o_orderkey) AS p, count(*) AS n FROM w GROUP BY o_custkey)
SELECT doc_id, cast(8 AS bigint) AS start_at, cast(8 + length(p) AS bigint) AS end_at, 'SEED_PHRASE' AS type, p AS value, 'secret' AS via
FROM v WHERE n >= 12""",
)
def sec_seed_phrase(spark, folder):
    words = view(spark, folder, _SEED_WORDS.format(first_word="split(p_name, ' ')[0]"), "o_custkey")
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", "word")))
    texts = words.groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.concat(F.lit("backup: "), F.array_join(F.transform(ordered, lambda s: s["word"]), " "), F.lit(" STOP done.")).alias("text")
    )
    wordlist = spark.table("part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return spans_out(seed_phrases(texts, wordlist, ["doc_id"]))
