"""Long values and long texts: nothing is cut off, nothing overflows, nothing is passed over."""

import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.operators import rules as R
from veil.operators.detect import detect
from veil.operators.guard import join_mentions, skipped_mentions
from veil.operators.records import explode_leaves
from veil.operators.secrets import seed_phrases
from veil.operators.tabular import detect_tables
from veil.operators.terms import detect_terms
from veil.operators.tokens import assign_tokens, token_sites
from veil.plans.redact import Lists, redact_corpus
from veil.sources.text import parse_ndjson, route_records

SECRET = {r.key: r for r in R.SECRETS + R.BUILTIN}
LONG = "aB3" * 1700


def values(spark, key, text):
    df = spark.createDataFrame([(0, text)], "doc_id int, text string")
    return [r.value for r in detect(df, [SECRET[key]], ["doc_id"]).orderBy("start_at").collect()]


@pytest.mark.parametrize("key,text,want", [
    ("SECRET", f"password: {LONG}1 end", [LONG + "1"]),
    ("CONNECTION_STRING", f"db postgres://{LONG}:{LONG}@{LONG}/x end", [f"postgres://{LONG}:{LONG}@{LONG}/x"]),
    ("API_KEY", f"ghp_{LONG} xoxb-{LONG} sk_live_{LONG}", [f"ghp_{LONG}", f"xoxb-{LONG}", f"sk_live_{LONG}"]),
    ("PRIVATE_KEY", "-----BEGIN " + "VERY " * 20000 + "PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", ["-----BEGIN " + "VERY " * 20000 + "PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----"]),
    ("EMAIL", "x@" + "ab." * 20000 + "com", ["x@" + "ab." * 20000 + "com"]),
    ("EMAIL", "x@" + "1." * 3000 + "1 but y@acme.com", ["y@acme.com"]),
    ("EMAIL", "a@b.com please@x.org and c @ d . org. Then e@f.g2.h", ["a@b.com", "please@x.org", "c @ d . org"]),
    ("EMAIL", "x@foo bar@baz.com", ["bar@baz.com"]),
    ("EMAIL", "a@b.com2x@y.org", ["a@b.com", "2x@y.org"]),
])
def test_long_values(spark, key, text, want):
    assert values(spark, key, text) == want


def test_email_as_backtracking_finds_it(spark):
    """The loop without backtracking agrees with the plain pattern on short texts of the same letters."""
    import itertools
    import random
    import re

    top = r"(?:\.[a-zA-Z]{2,}| \. ?[a-z]{2,}|\. [a-z]{2,})"
    label = r"(?:\.[a-zA-Z0-9-]+| \. ?[a-z0-9-]+|\. [a-z0-9-]+)(?: [a-z0-9-]+)?"
    plain = re.compile(rf"[a-zA-Z0-9._%+-]+ ?@ ?[a-zA-Z0-9-]+(?: [a-z0-9-]+)?(?:{label})*{top}")
    r = random.Random(3)
    texts = ["".join(t) for t in itertools.product("a@. 1", repeat=6) if "@" in t] + ["".join(r.choice("ab@..  1A-") for _ in range(30)) for _ in range(3000)]
    df = spark.createDataFrame([(i, "@" + t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {i: [] for i in range(len(texts))}
    for x in detect(df, [SECRET["EMAIL"]], ["doc_id"]).orderBy("start_at").collect():
        got[x.doc_id].append(x.value)
    assert got == {i: [m[0] for m in plain.finditer("@" + t)] for i, t in enumerate(texts)}


def test_wallet_runs_of_any_length(spark):
    words = "able acid also area army atom aunt away baby band bean best seed".split()
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    texts = [(0, "seed " + " ".join(words[:12])), (1, "word " * 20000), (2, " ".join(words * 1000)), (3, " ".join(words[:11]))]
    got = {r.doc_id: r.value for r in seed_phrases(spark.createDataFrame(texts, "doc_id int, text string"), listed, ["doc_id"]).collect()}
    assert got == {0: texts[0][1], 2: texts[2][1]}


def test_terms_of_any_signs(spark):
    texts = [(0, "the \u00c9RATION and C++ or c+ too"), (1, "lib\u00e9ration .NET x.net"), (2, "project  x")]
    terms = spark.createDataFrame([("\u00e9ration",), ("C++",), (".net",), ("project",), ("++",), (None,)], "t string")
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = sorted((r.doc_id, r.start_at, r.value) for r in detect_terms(df, terms, ["doc_id"]).collect())
    assert got == [(0, 4, "\u00c9RATION"), (0, 16, "C++"), (1, 11, ".NET"), (1, 17, ".net"), (2, 0, "project")]
    config = Config.only(custom_terms=("\u00e9ration",))
    assert [r.value for r in detect(df, R.term_rule(config), ["doc_id"]).collect()] == ["\u00c9RATION"]


def test_maps_of_anything(spark):
    df = spark.sql("SELECT 1 AS id, map('a', named_struct('x', 'one', 'n', 1), 'b', named_struct('x', 'two', 'n', 2)) AS m, map('k', array('p', 'q')) AS l, map(7, 'seven') AS n")
    got = {(r.field_path, r.key, r.value) for r in explode_leaves(df, ["id"]).collect()}
    assert got == {("m.a.x", "x", "one"), ("m.b.x", "x", "two"), ("l.k[0]", "k", "p"), ("l.k[1]", "k", "q"), ("n.7", "7", "seven")}


def test_json_lines_with_any_id(spark):
    lines = ['{"id": 3, "method": "m"}', '{"id": "a-1", "method": "m"}', '{"method": "note"}', '{"id": 4, "meth', "", "null", "plain"]
    got = parse_ndjson(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(((r.id, r.method) for r in got), key=repr) == [("3", "m"), ("a-1", "m"), (None, "note")]


def test_requests_of_two_sessions(spark):
    asked = spark.createDataFrame([("a", 1, "tools/call"), ("a", 1, "tools/call"), ("b", 1, "tools/list")], "session_id string, id int, method string")
    said = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "session_id string, id int, result string")
    got = sorted((r.session_id, r.route) for r in route_records(asked, said).collect())
    assert got == [("a", "data"), ("b", "descriptions"), ("c", "pass")]


def test_limits_are_parameters(spark):
    prompts = spark.createDataFrame([(0, "see @big.txt and @small.txt")], "id int, prompt string")
    files = spark.createDataFrame([("big.txt", 9_000_000, "x"), ("small.txt", 5, "y")], "path string, size long, content string")
    assert join_mentions(prompts, files, ["id"]).count() == 2 and join_mentions(prompts, files, ["id"], most_bytes=None).count() == 3
    assert [r.path for r in skipped_mentions(prompts, files, ["id"]).collect()] == ["big.txt"]
    rows = [(0, i, 0, 3, "v", "v", f"b{i}", "a", "EMAIL") for i in range(50)]
    found = spark.createDataFrame(rows, "session_id int, doc_id int, start_at int, end_at int, value string, surface string, before string, after string, type string")
    named = found.crossJoin(assign_tokens(found).select("token"))
    assert (token_sites(named).count(), token_sites(named, most=None).count()) == (32, 50)
    table = spark.createDataFrame([(0, "\n".join(["prose here"] * 9 + ["id,date_of_birth,note", "1,1990-01-02,note"]))], "doc_id int, text string")
    assert (detect_tables(table, ["doc_id"], ("header",)).count(), detect_tables(table, ["doc_id"], ("header",), header_lines=None).count()) == (0, 1)


def test_whole_pass_leaves_no_tail_of_a_secret(spark):
    """Long secrets, wallet phrases and listed terms go in the whole pass, with string ids."""
    words = "able acid also area army atom aunt away baby band bean best".split()
    texts = [("s", "d1", f"password: {'x9' * 400} end"), ("s", "d2", "note " + " ".join(words) + " END"), ("s", "d3", "project Blue Heron starts")]
    corpus = spark.createDataFrame(texts, "session_id string, doc_id string, text string")
    lists = Lists(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([("blue heron",)], "t string"))
    got = {r.doc_id: r.redacted for r in redact_corpus(corpus, Config(), lists=lists).redacted.collect()}
    assert got == {"d1": "password: [SECRET_1] end", "d2": "note [SEED_PHRASE_1] END", "d3": "project [CUSTOM_1] starts"}


def test_label_over_a_line_break(spark):
    df = spark.createDataFrame([(0, "first_name\n: jennifer")], "doc_id int, text string")
    from veil.operators.labels import label_rules

    assert [r.value for r in detect(df, label_rules(), ["doc_id"]).where(F.col("type") == "PERSON").collect()] == ["jennifer"]


def test_addresses_as_the_plain_pattern_finds_them(spark):
    """Tried once a run, the pattern finds what it finds when tried at every character."""
    import random
    import re

    from veil.operators.known import url_zones

    plain = re.compile(r"(?i)(?:[a-z][a-z0-9+.-]*://|www\.)[^\s\"'<>]+|/[A-Za-z0-9._~%\-/]{3,}|[A-Za-z0-9._~%-]+\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|rtf|zip|png|jpe?g|gif|html?)(?![A-Za-z0-9_])")
    r, bits = random.Random(5), ["a", "b", "9", ".", "-", "~", "%", "+", "/", "://", ":", " ", "www.", ".pdf", ".txt", "x.gif", "_", "'", "http"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", url_zones(F.col("t")).alias("z"))
    got = {x.i: [(z.p, z.s) for z in x.z] for x in df.collect()}
    assert got == {i: [(m[0], m.start()) for m in plain.finditer(t)] for i, t in enumerate(texts)}


@pytest.mark.parametrize("piece", ["a", "ab.", "aB3", "a-", "/", "ab/", "%41", "x: "])
def test_addresses_in_a_million_characters(spark, piece):
    from veil.operators.known import url_zones

    text = (piece * 1_000_000)[:1_000_000] + " x.pdf"
    last = spark.createDataFrame([(text,)], "t string").select(F.element_at(url_zones(F.col("t")), -1).alias("z")).first().z
    assert text.endswith(last.p) and last.s + len(last.p) == len(text)
