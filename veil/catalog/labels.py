"""Label-, key- and table-driven detection, and names in prose."""

from pyspark.sql import functions as F

from veil.catalog import views as V
from veil.catalog.base import matches_sql, pad, pick, query, quoted, re2, spans_out, view
from veil.config import Config
from veil.lexicons import Lexicons
from veil.operators import labels as L
from veil.operators.detect import detect
from veil.operators.persons import PERSON_RULES
from veil.operators.records import detect_fields
from veil.operators.resolve import resolve_overlaps
from veil.operators.tabular import detect_tables

LEX = Lexicons()
KNOWN, STOP, TITLES = quoted(LEX.first_names), quoted(LEX.stopwords), quoted(LEX.honorifics)
RULES = {r.key: r for r in L.label_rules()}


def word_norm_sql(w: str) -> str:
    return f"regexp_replace(lower({w}), '[.''’\\-]+$', '')"


def name_steps_sql(cap: str, explicit: str) -> str:
    """CTE ``n``: rows of ``e`` whose captured value passes the name check, with ``kept``."""
    droppable = f"({word_norm_sql('w[i]')} IN ({STOP}) AND {word_norm_sql('w[i]')} NOT IN ({KNOWN}))"
    first = " ".join(f"WHEN {k} THEN regexp_extract(cap, '^\\S+" + "\\s+\\S+" * (k - 1) + "')" for k in (1, 2, 3))
    return f""", w AS (SELECT *, {cap} AS cap, {explicit} AS explicit, string_split_regex({cap}, '\\s+') AS w FROM e),
k AS (SELECT *, list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND {droppable} THEN 1 ELSE i END)) AS keep FROM w),
n AS (SELECT *, CASE keep {first} END AS kept FROM k WHERE {word_norm_sql('w[1]')} NOT IN ({STOP}) AND (explicit
 OR list_bool_and(list_transform(w[1:keep], lambda t: regexp_matches(t, '^[A-Z]')))
 OR list_bool_or(list_transform(w[1:keep], lambda t: {word_norm_sql('t')} IN ({KNOWN})))))"""


def label_query(name: str, key: str, pattern: str, via: str, valid: str = "true", **kw) -> None:
    rule = RULES[key]
    if rule.type == "PERSON" and key != "MAIDEN":
        either = key == "LABEL_NAME"
        lead = "concat(g1[i], g3[i])" if either else "g1[i]"
        cap = "concat(g2[i], g4[i])" if either else "g2[i]"
        oracle = (
            matches_sql(V.LABELS, pattern, lead=lead, value=cap, groups=4 if either else 2)
            + name_steps_sql("value", "g1[i] <> ''")
            + f" SELECT doc_id, start_at, start_at + length(kept) AS end_at, 'PERSON' AS type, kept AS value, '{via}' AS via FROM n"
        )
    else:
        oracle = (
            matches_sql(V.LABELS, pattern, groups=kw.get("groups", 2), lead=kw.get("lead", "g1[i]"), value=kw.get("value", "g2[i]"))
            + f" SELECT doc_id, start_at, start_at + length(value) AS end_at, '{rule.type}' AS type, value, '{via}' AS via FROM e WHERE {valid}"
        )

    @query(name, oracle)
    def run(spark, folder):
        return spans_out(detect(view(spark, folder, V.LABELS), [rule], ["doc_id"]))


def guarded(pattern: str, before: str) -> str:
    """Turn a pattern's leading look-behind into a captured character."""
    return re2(pattern[: pattern.index("(?<!")] + pattern[pattern.index(")", pattern.index("(?<!")) + 1 :]).replace("(", "(" + before, 1)


MONTHS = quoted(L.MONTHS)
VALID_DATE = f"""regexp_matches(value, '\\b(1[89]\\d\\d|20\\d\\d)\\b')
 AND NOT coalesce(list_bool_or(list_transform(regexp_extract_all(regexp_replace(value, '(?i)(st|nd|rd|th)\\b', '', 'g'), '\\d{{1,4}}'), lambda n: cast(n AS int) BETWEEN 32 AND 999)), false)
 AND (NOT regexp_matches(value, '[A-Za-z]{{3,9}}') OR lower(regexp_extract(value, '[A-Za-z]{{3,9}}')) IN ({MONTHS}))"""
HAS_DIGIT = "regexp_matches(value, '[0-9]')"

label_query("lab_name", "LABEL_NAME", "(?i)" + re2(L.LABEL_NAME), "label")
label_query("lab_field_name", "FIELD_NAME", "(?i)" + guarded(L.FIELD_NAME, r"(?:^|[^_\-]|(?:^|[^A-Za-z])[_\-])"), "field")
label_query("lab_maiden", "MAIDEN", re2(L.MAIDEN), "label")
label_query("lab_id", "LABEL_ID", "(?i)" + re2(L.LABEL_ID), "label", HAS_DIGIT)
label_query("lab_field_id", "FIELD_ID", "(?i)" + guarded(L.FIELD_ID, r"(?:^|[^_\-]|(?:^|[^A-Za-z0-9])[_\-])"), "field", HAS_DIGIT)
label_query("lab_dob", "LABEL_DOB", "(?i)" + re2(L.LABEL_DOB), "checksum", VALID_DATE)
label_query("lab_field_dob", "FIELD_DOB", "(?i)" + guarded(L.FIELD_DOB, r"(?:^|[^_\-]|(?:^|[^A-Za-z])[_\-])"), "checksum", VALID_DATE)

NAME_CANDIDATES = f"""SELECT c_custkey AS doc_id, {pick('c_custkey', ['Jennifer ', 'jane ', 'The ', 'Acme ', 'behind '])} || {pick('cast(floor(c_custkey / 5) as bigint)', ['doe', 'Holdings', 'Please', 'of the', 'Testcase Report'])} AS text,
 c_custkey % 2 = 0 AS explicit FROM customer"""


@query(
    "valid_name",
    f"WITH e AS ({NAME_CANDIDATES})" + name_steps_sql("text", "explicit") + " SELECT doc_id, cap AS captured, kept FROM n",
)
def valid_name(spark, folder):
    kept = L.valid_name(F.col("text"), F.col("explicit"), LEX)
    return view(spark, folder, NAME_CANDIDATES).select("doc_id", F.col("text").alias("captured"), kept.alias("kept")).where("kept is not null")


DATE_CANDIDATES = f"""SELECT o_orderkey AS doc_id, {pick('o_orderkey', ['', '3rd March ', 'Widget 4, ', '31/12/', '99-'])} || cast(1790 + o_custkey % 400 as string) ||
 {pick('cast(floor(o_orderkey / 5) as bigint)', ['', '-06-21', '-45-01'])} AS value FROM orders"""


@query("valid_date", f"SELECT doc_id, value FROM ({DATE_CANDIDATES}) WHERE {VALID_DATE}")
def valid_date(spark, folder):
    return view(spark, folder, DATE_CANDIDATES).where(L.valid_date(F.col("value")))


KEYS = ["first_name", "company_name", "DOB", "birth-date", "passport no", "id", "tax_ref", "names", "Account Holder Name", "ssn", "file_name", "drivers license", "candidate", "email"]
KEY_VIEW = f"SELECT c_custkey AS doc_id, {pick('c_custkey', KEYS)} || {pick('cast(floor(c_custkey / 14) as bigint)', ['', '', '_x'])} AS key FROM customer"
COLUMN_CASE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{re2(p)}') THEN '{t}'" for p, t in L.COLUMN_TYPES) + " END"
BARE_HEADER = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^\**|\**$', '', 'g')"


def column_type_sql(cell: str) -> str:
    return COLUMN_CASE.format(BARE_HEADER.format(cell))


@query(
    "key_classify",
    f"""SELECT doc_id, key, CASE WHEN regexp_matches(key, '{re2(L.KEY_NAME)}') THEN 'full name' WHEN regexp_matches(key, '{re2(L.KEY_DOB)}') THEN 'date of birth'
 WHEN regexp_matches(key, '{re2(L.KEY_ID)}') THEN 'national id' END AS label FROM ({KEY_VIEW})""",
)
def key_classify(spark, folder):
    return view(spark, folder, KEY_VIEW).withColumn("label", L.key_label(F.col("key")))


HEADERS = ["**Name**", " e-mail ", "Date of Birth", "msisdn", "home address", "note", "company_name", "Student-Name", "dob*"]
HEADER_VIEW = f"SELECT c_custkey AS doc_id, {pick('c_custkey', HEADERS)} || {pick('cast(floor(c_custkey / 9) as bigint)', ['', '', 's'])} AS header FROM customer"


@query("column_type", f"SELECT doc_id, header, {column_type_sql('header')} AS type FROM ({HEADER_VIEW})")
def column_type(spark, folder):
    return view(spark, folder, HEADER_VIEW).withColumn("type", L.column_type(F.col("header")))


FIELDS = f"""SELECT c_custkey AS doc_id, {pick('c_custkey', ['first_name', 'dob', 'passport', 'notes', 'id', 'email'])} AS key,
 CASE c_custkey % 6 WHEN 0 THEN {pick('cast(floor(c_custkey / 6) as bigint)', V.FIRST)} || ' Testcase' WHEN 1 THEN '198' || cast(c_custkey % 10 as string) || '-03-04' WHEN 2 THEN 'A' || {pad('c_custkey', 7)}
 WHEN 3 THEN 'nothing here ' || cast(c_custkey as string) WHEN 4 THEN 'A' || {pad('c_custkey', 7)} ELSE 'u' || cast(c_custkey as string) || '@acme.co.za' END AS value FROM customer"""


@query(
    "redact_field",
    f"""SELECT doc_id, cast(0 AS bigint) AS start_at, length(value) AS end_at,
 CASE key WHEN 'first_name' THEN 'PERSON' WHEN 'dob' THEN 'DOB' WHEN 'passport' THEN 'ID' ELSE 'EMAIL' END AS type, value,
 CASE key WHEN 'first_name' THEN 'label' WHEN 'dob' THEN 'checksum' WHEN 'passport' THEN 'field' ELSE 'structural' END AS via, key <> 'email' AS declared
 FROM ({FIELDS}) WHERE key IN ('first_name', 'dob', 'passport', 'email')""",
)
def redact_field(spark, folder):
    config = Config(tables=False)
    found = detect_fields(view(spark, folder, FIELDS), ["doc_id"], config, spark)
    kept = resolve_overlaps(found, ["doc_id"])
    return spans_out(kept).join(kept.select("doc_id", F.col("start_at").cast("bigint").alias("start_at"), "declared"), ["doc_id", "start_at"])


# ---- tables in text
TABLES = f"""SELECT c_custkey AS doc_id, CASE c_custkey % 4
 WHEN 0 THEN 'export' || chr(10) || 'id,name,date_of_birth,note' || chr(10) || cast(c_custkey as string) || ', ' || {pick('c_custkey', V.FIRST)} || ' Testcase ,1990-01-' || {pad('c_custkey % 28 + 1', 2)} || ',note' || chr(10) || 'x,-,y' || chr(10) || '7,---,1991-02-03,zz' || chr(10) || '8,Ann B,,q'
 WHEN 1 THEN '| Date of birth | 1951-06-' || {pad('c_custkey % 28 + 1', 2)} || ' |' || chr(10) || '| **Name** | ' || {pick('c_custkey', V.FIRST)} || ' Li |' || chr(10) || '| phone | email |' || chr(10) || '| note | zz |'
 WHEN 2 THEN 'a' || chr(9) || 'E-mail' || chr(9) || 'Home Address' || chr(10) || 'b' || chr(9) || 'u' || cast(c_custkey as string) || '@acme.com' || chr(9) || ' 12 Long Street ' || chr(10) || 'c' || chr(9) || chr(9) || 'z'
 ELSE '<table><tr><td>Name</td><td> ' || {pick('c_custkey', V.FIRST)} || ' Ramesh </td></tr><tr><th>dob</th><td><b>1990</b></td></tr><TR><TD>Mobile</TD><TD>082 ' || {pad('c_custkey', 7)} || '</TD><td>email</td><td>name</td></TR></table>' END AS text FROM customer"""
CELLS_SQL = f"""WITH v AS ({TABLES}),
l AS (SELECT doc_id, i, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS line_at
 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM v), unnest(range(1, len(ls) + 1)) AS t(i)),
s AS (SELECT doc_id, i, line, line_at, d, string_split(line, d) AS cs FROM l, (VALUES (chr(9)), ('|'), (',')) AS dd(d)),
c AS (SELECT doc_id, i, line, d, j, cs[j] AS cell, len(cs) AS n, line_at + coalesce(list_sum(list_transform(cs[1:j-1], lambda x: length(x) + 1)), 0)
   + length(cs[j]) - length(regexp_replace(cs[j], '^\\s+', '')) AS start_at, regexp_replace(cs[j], '^\\s+|\\s+$', '', 'g') AS value, {column_type_sql('cs[j]')} AS ct
 FROM s, unnest(range(1, len(cs) + 1)) AS t(j)),
h AS (SELECT doc_id, d, min(i) AS hi FROM c WHERE i <= 5 AND contains(line, d) AND ct IS NOT NULL AND NOT regexp_matches(line, '\\d{{4}}|@') GROUP BY doc_id, d)"""
OUT = "cast({0}start_at AS bigint) AS start_at, cast({0}start_at + length({0}value) AS bigint) AS end_at, {1} AS type, {0}value, 'field' AS via"


@query(
    "tab_header",
    CELLS_SQL
    + f""" SELECT b.doc_id, {OUT.format('b.', 'a.ct')} FROM h JOIN c a ON a.doc_id = h.doc_id AND a.d = h.d AND a.i = h.hi AND a.ct IS NOT NULL
 JOIN c b ON b.doc_id = h.doc_id AND b.d = h.d AND b.i > h.hi AND b.j = a.j AND b.n = a.n WHERE length(b.value) > 1 AND NOT regexp_full_match(b.value, '-+')""",
)
def tab_header(spark, folder):
    return spans_out(detect_tables(view(spark, folder, TABLES), ["doc_id"], ("header",)))


@query(
    "tab_adjacent",
    CELLS_SQL
    + f""" SELECT b.doc_id, {OUT.format('b.', 'a.ct')} FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.d = a.d AND b.i = a.i AND b.j = a.j + 1
 WHERE a.ct IS NOT NULL AND b.ct IS NULL AND length(b.value) > 1 AND NOT regexp_full_match(b.value, '-+') AND NOT regexp_full_match(b.value, '[a-z][a-z0-9_]*')""",
)
def tab_adjacent(spark, folder):
    return spans_out(detect_tables(view(spark, folder, TABLES), ["doc_id"], ("adjacent",)))


@query(
    "tab_html",
    matches_sql(TABLES, r"(?i)(<t[dh][^>]*>)((?s:.*?))(</t[dh]>)", lead="g1[i]", value="g2[i]", groups=3)
    + f""", p AS (SELECT *, lag({column_type_sql("regexp_replace(value, '<[^>]+>', '', 'g')")}) OVER (PARTITION BY doc_id ORDER BY i) AS before_type FROM e),
q AS (SELECT doc_id, start_at + length(value) - length(regexp_replace(value, '^\\s+', '')) AS start_at, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value, before_type
 FROM p WHERE before_type IS NOT NULL AND NOT regexp_matches(value, '<[^>]+>'))
SELECT doc_id, {OUT.format('', 'before_type')} FROM q WHERE length(value) > 1 AND {column_type_sql('value')} IS NULL""",
)
def tab_html(spark, folder):
    return spans_out(detect_tables(view(spark, folder, TABLES), ["doc_id"], ("html",)))


# ---- names in prose
WORDS_BEFORE = "regexp_extract(right(substr(text, 1, start_at), 14), '\\b([A-Za-z]{2,12})\\.?\\s+$', 1)"
RUN = r"(^|[^\p{L}\p{N}])(\p{Lu}[\p{L}\p{M}''’.\-]*[\p{Ll}\p{M}''’](?: +\p{Lu}[\p{L}\p{M}''’.\-]*[\p{Ll}\p{M}''’]){0,2})"


def person_query(name: str, keys: tuple[str, ...], oracle: str, mode: str = "balanced"):
    rules = [r for r in PERSON_RULES if r.key in keys]

    @query(name, oracle)
    def run(spark, folder):
        return spans_out(detect(view(spark, folder, V.PEOPLE), rules, ["doc_id"], Config(person_mode=mode)))


INITIALS_SQL = (
    matches_sql(V.PEOPLE, r"(^|[^\p{L}\p{N}])((?:\p{Lu}\.[ \t]?){1,3}\p{Lu}[\p{L}\p{M}''’\-]*[\p{Ll}\p{M}''’])", lead="g1[i]", value="g2[i]", groups=2)
    + " SELECT doc_id, start_at, start_at + length(value) AS end_at, 'PERSON' AS type, value, 'gazetteer' AS via FROM e"
)
_LOWER = f"list_transform(w, lambda t: {word_norm_sql('t')})"
RUNS_STEPS = (
    matches_sql(V.PEOPLE, RUN, lead="g1[i]", value="g2[i]", groups=2)
    + f""", a AS (SELECT *, string_split_regex(value, '\\s+') AS w, lower({WORDS_BEFORE}) AS title_before FROM e),
b AS (SELECT *, {_LOWER} AS lw FROM a),
c AS (SELECT *, lw[1] IN ({TITLES}) AND len(w) >= 2 AS title_first, title_before IN ({TITLES}) AS titled,
  list_position(list_transform(lw, lambda t: t IN ({KNOWN})), true) AS known_at FROM b WHERE NOT list_bool_and(list_transform(lw, lambda t: t IN ({STOP})))),
d AS (SELECT *, CASE WHEN title_first THEN w[2] WHEN titled THEN w[1] WHEN known_at BETWEEN 1 AND len(w) - 1 THEN w[known_at] END AS first_word FROM c),
f AS (SELECT doc_id, start_at + strpos(value, first_word) - 1 AS p0, substr(value, strpos(value, first_word)) AS v, title_first OR titled AS by_title FROM d WHERE first_word IS NOT NULL),
k AS (SELECT *, string_split_regex(v, '\\s+') AS w FROM f),
m2 AS (SELECT *, list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND {word_norm_sql('w[i]')} IN ({STOP}) AND lower(w[i]) NOT IN ({KNOWN}) THEN 1 ELSE i END)) AS keep FROM k),
runs AS (SELECT doc_id, p0 AS start_at, array_to_string(w[1:keep], ' ') AS value, by_title,
  list_bool_or(list_transform(w[1:keep], lambda t: {word_norm_sql('t')} IN ({KNOWN}))) AS known FROM m2)"""
)
RUN_OUT = """ SELECT doc_id, start_at, start_at + length(value) AS end_at, 'PERSON' AS type, value,
 CASE WHEN known THEN 'gazetteer' ELSE 'honorific' END AS via FROM runs"""

person_query("per_initials", ("INITIALS",), INITIALS_SQL)
person_query("per_honorific", ("TITLE_RUN",), RUNS_STEPS + RUN_OUT)
person_query("per_strict", ("TITLE_RUN",), RUNS_STEPS + RUN_OUT + " WHERE NOT by_title OR known", mode="strict")


@query("per_gazetteer", RUNS_STEPS + " SELECT value, count(*) AS hits, count(DISTINCT doc_id) AS texts FROM runs WHERE known GROUP BY value")
def per_gazetteer(spark, folder):
    rules = [r for r in PERSON_RULES if r.key == "TITLE_RUN"]
    found = detect(view(spark, folder, V.PEOPLE), rules, ["doc_id"], Config()).where("via = 'gazetteer'")
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("texts"))


TRIM_VIEW = f"SELECT c_custkey AS doc_id, {pick('c_custkey', V.FIRST)} || ' ' || {pick('cast(floor(c_custkey / 7) as bigint)', ['Please', 'Doe Please', 'Thanks Regards', 'Ming Invoice', 'Doe'])} AS text FROM customer"


@query(
    "per_trim_stop",
    f"""WITH v AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM ({TRIM_VIEW})),
k AS (SELECT *, list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND lower(w[i]) IN ({STOP}) AND lower(w[i]) NOT IN ({KNOWN}) THEN 1 ELSE i END)) AS keep FROM v)
SELECT doc_id, text, array_to_string(w[1:keep], ' ') AS name FROM k""",
)
def per_trim_stop(spark, folder):
    stop, known = list(LEX.stopwords), list(LEX.first_names)
    keep = L.kept_words(F.split("text", " "), lambda w: L.word_norm(w).isin(stop) & ~F.lower(w).isin(known))
    return view(spark, folder, TRIM_VIEW).withColumn("name", L.first_words(F.col("text"), keep))


person_query(
    "per_caps", ("INITIALS", "TITLE_RUN", "CAPS_RUN"),
    RUNS_STEPS
    + f""", others AS (SELECT doc_id, start_at, value, CASE WHEN known THEN 'gazetteer' ELSE 'honorific' END AS via FROM runs
 UNION ALL SELECT doc_id, start_at, value, via FROM ({INITIALS_SQL})),
caps AS (SELECT doc_id, start_at, value, 'gazetteer' AS via FROM ({matches_sql(V.PEOPLE, r"\b[A-Z][A-Z''’.\-]*[A-Z](?:[ \t]+[A-Z][A-Z''’.\-]*[A-Z]){1,2}\b")}
 SELECT * FROM e) q WHERE {word_norm_sql("string_split_regex(value, '\\s+')[1]")} IN ({KNOWN})
 AND NOT list_bool_or(list_transform(string_split_regex(value, '\\s+'), lambda t: {word_norm_sql('t')} IN ({STOP}))))
SELECT doc_id, start_at, start_at + length(value) AS end_at, 'PERSON' AS type, value, via FROM (SELECT * FROM others UNION ALL
 SELECT * FROM caps c WHERE NOT EXISTS (SELECT 1 FROM others o WHERE o.doc_id = c.doc_id AND c.start_at < o.start_at + length(o.value) AND c.start_at + length(c.value) > o.start_at))""",
)
