"""The whole pass: learning, masking, restoring, streams, audit."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.functions import crypto as C
from veil.operators import tokens as T
from veil.operators.audit import leak_events, quota_state
from veil.operators.resolve import enough_instances
from veil.operators.secrets import is_wallet_list, seed_phrases
from veil.plans.redact import KEYS, find, redact_corpus
from veil.sources import sinks
from veil.streaming.jobs import SessionTokens

TEXTS = [
    (1, 0, "Full name: Oliver Testcase and Oliver_Testcase here"),
    (2, 0, "mail marcus.delacroix@example.com"),
    (2, 1, "see /files/marcus.delacroix%40example.com/cv.pdf or https://x.com/in/mdelacroix87"),
    (3, 0, "Name: Jennifer Cook"),
    (3, 1, "open cookbook.pdf please, JENNIFER COOK and jennifer"),
    (4, 0, '"tax_number": "0123456789"'),
    (4, 1, "SARS tax ref 0123456789"),
    (5, 0, "first_name: Jennifer\nlast_name: Delacroix"),
    (5, 1, "profile https://x.org/Jennifer-Delacroix and jdelacroix.pdf"),
    (6, 0, "nothing known delacroix.pdf"),
    (7, 0, "write jane@acme.com or JANE@ACME.COM "),
]
WANT = {
    (1, 0): "Full name: [PERSON_1] and [PERSON_1] here",
    (2, 0): "mail [EMAIL_1]",
    (2, 1): "see /files/[EMAIL_1]/cv.pdf or https://x.com/in/[EMAIL_1]",
    (3, 0): "Name: [PERSON_1]",
    (3, 1): "open cookbook.pdf please, [PERSON_1] and [PERSON_1]",
    (4, 0): '"tax_number": "[ID_1]"',
    (4, 1): "SARS tax ref [ID_1]",
    (5, 0): "first_name: [PERSON_1]\nlast_name: [PERSON_2]",
    (5, 1): "profile https://x.org/[PERSON_2] and [PERSON_2].pdf",
    (6, 0): "nothing known delacroix.pdf",
    (7, 0): "write [EMAIL_1] or [EMAIL_1] ",
}


@pytest.fixture(scope="module")
def done(spark):
    corpus = spark.createDataFrame(TEXTS, "session_id int, doc_id bigint, text string")
    result = redact_corpus(corpus)
    return corpus, result


def test_masked(done):
    got = {(r.session_id, r.doc_id): r.redacted for r in done[1].redacted.collect()}
    assert got == WANT


def test_spans_are_disjoint_and_true(done):
    texts = {(s, d): t for s, d, t in TEXTS}
    last = {}
    for r in sorted(done[1].findings.collect(), key=lambda r: (r.session_id, r.doc_id, r.start_at)):
        key = (r.session_id, r.doc_id)
        assert texts[key][r.start_at : r.end_at] == r.surface
        assert r.start_at >= last.get(key, 0)
        last[key] = r.end_at


def test_one_token_per_value(done):
    rows = done[1].token_map.collect()
    assert len({(r.session_id, r.token) for r in rows}) == len(rows) == len({(r.session_id, r.type, r.norm) for r in rows})


def test_restored_where_context_tells(spark):
    lines = [(0, i, f"line {i}: please write to {a}@acme.com about the thing we discussed") for i, a in enumerate(["jane", "Jane", "bob"])]
    corpus = spark.createDataFrame(lines, "session_id int, doc_id bigint, text string")
    r = redact_corpus(corpus)
    back = T.rehydrate(r.redacted, r.token_map, r.sites, KEYS)
    assert back.where("restored <> text").count() == 0
    elsewhere = spark.createDataFrame([(0, 9, "ask [EMAIL_1]"), (0, 10, "[EMAIL_99] stays")], "session_id int, doc_id bigint, redacted string")
    got = {x.doc_id: x.restored for x in T.rehydrate(elsewhere, r.token_map, r.sites, KEYS).collect()}
    assert got == {9: "ask jane@acme.com", 10: "[EMAIL_99] stays"}


@pytest.mark.parametrize("kind,made", [("bigint", lambda i: i), ("bigint", lambda i: (1 << 61) + i * 10**12), ("string", lambda i: f"id-{i:05d}")])
def test_numbers_run_on_over_ranges(spark, kind, made):
    """Dense, sparse and string ids, over more partitions than values in a type."""
    rows = [(0, made(i), 0, 3, f"v{i % 50}", t) for i in range(200) for t in ("EMAIL", "PHONE")]
    found = spark.createDataFrame(rows, f"session_id int, doc_id {kind}, start_at int, end_at int, value string, type string").repartition(13)
    got = {(r.type, r.norm): r.ordinal for r in T.assign_tokens(found).collect()}
    assert got == {(t, f"v{i}"): i + 1 for i in range(50) for t in ("EMAIL", "PHONE")}


def test_a_copy_held_by_a_third_of_all_rows(spark):
    rows = [(0, i, "mail hot@acme.com now" if i % 3 == 0 else f"mail u{i}@acme.com now") for i in range(600)]
    corpus = spark.createDataFrame(rows, "session_id int, doc_id bigint, text string")
    r = redact_corpus(corpus, Config.only("EMAIL"))
    got = {x.doc_id: x.redacted for x in r.redacted.collect()}
    assert got[0] == got[3] == got[597] == "mail [EMAIL_1] now" and len(got) == 600
    assert r.sites.groupBy("token").count().agg(F.max("count")).first()[0] <= 32


def test_config(spark):
    corpus = spark.createDataFrame([(0, 0, "mail jane@acme.com on host 10.0.0.1"), (0, 1, "mail bob@acme.com and bob@acme.com")], "session_id int, doc_id bigint, text string")
    run = lambda **kw: sorted((r.doc_id, r.type) for r in find(corpus, Config(**{"sweep": False, **kw})).collect())
    assert run() == [(0, "EMAIL"), (0, "IPV4"), (1, "EMAIL"), (1, "EMAIL")]
    assert run(detectors=Config.profile("code").detectors) == [(0, "EMAIL"), (1, "EMAIL"), (1, "EMAIL")]
    assert run(allow_terms=("JANE@acme.com ",)) == [(0, "IPV4"), (1, "EMAIL"), (1, "EMAIL")]
    assert run(min_confidence_level="high") == [(0, "EMAIL"), (1, "EMAIL"), (1, "EMAIL")]
    assert run(instance_threshold={"EMAIL": 2}) == [(0, "IPV4"), (1, "EMAIL"), (1, "EMAIL")]
    terms = find(corpus, Config(sweep=False, custom_terms=("host", "on host"), custom_patterns=({"type": "EMP", "pattern": "jane"}, {"pattern": "("})))
    assert [(r.type, r.value) for r in terms.where("type in ('CUSTOM', 'EMP')").orderBy("start_at").collect()] == [("EMP", "jane"), ("CUSTOM", "on host")]


def test_instances_count_places_once(spark):
    rows = [(0, "EMAIL", 0, 5), (0, "EMAIL", 0, 5), (1, "EMAIL", 0, 5), (1, "EMAIL", 9, 12)]
    found = spark.createDataFrame(rows, "doc_id int, type string, start_at int, end_at int")
    assert {r.doc_id for r in enough_instances(found, ["doc_id"], {"EMAIL": 2}).collect()} == {1}


def test_fingerprint_is_hmac(spark):
    key = C.derive_key("blind", "acme", "master")
    ipad, opad = (F.lit(p) for p in C.hmac_pads(key))
    df = spark.createDataFrame([(" Jane@Acme.COM ",), ("é☂",), ("",)], "v string")
    got = [r[0] for r in df.select(C.blind_index(F.col("v"), ipad, opad)).collect()]
    assert got == [hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in ("jane@acme.com", "é☂")] + [""]


def test_events_and_sinks_hold_no_values(spark, done, tmp_path):
    ipad, opad = (F.lit(p) for p in C.hmac_pads(C.derive_key("blind", "t", "m")))
    events = leak_events(done[1].token_map, None, ipad, opad, F.lit(C.derive_key("enc", "t", "m").hex()))
    path = str(tmp_path / "events")
    sinks.write_events(events, path)
    stored = " ".join(str(r) for r in spark.read.parquet(path).collect()).lower()
    assert not any(v in stored for v in ("delacroix", "jennifer", "0123456789", "jane"))
    with pytest.raises(ValueError):
        sinks.write_events(events.withColumn("value", F.lit("x")), path)


def test_quota(spark):
    usage = spark.createDataFrame([("a", 250), ("b", 10)], "tenant string, used bigint")
    plans = spark.createDataFrame([("a", "trial", 250, 799), ("b", "big", -1, 0), ("c", "trial", 20, 0)], "tenant string, plan string, limit_n bigint, credits bigint")
    got = {r.tenant: r for r in quota_state(usage, plans).collect()}
    assert got["a"].headroom == 799 and got["a"].remaining == 0 and not got["a"].paused
    assert got["b"].headroom is None and not got["b"].paused and got["c"].low


def test_seed_phrases(spark):
    words = "able acid also area army atom aunt away baby band bean best".split()
    texts = [(0, "note " + " ".join(words) + " END"), (1, " ".join(words[:11]) + " zzzz able"), (2, "Make sure internal launch campaign doc also aligns with other docs strategy")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    assert [(r.doc_id, r.value, r.start_at) for r in seed_phrases(df, listed, ["doc_id"]).collect()] == [(0, " ".join(words), 5)]
    assert not is_wallet_list(words)


def test_stream_keeps_tokens_between_batches(spark, tmp_path):
    def batch(no, rows):
        return spark.createDataFrame([(s, d, t, e) for s, d, t, e in rows], "session_id string, doc_id bigint, text string, is_end boolean").select(
            "session_id", "doc_id", F.expr(f"timestamp '2024-01-01 00:00:00' + interval {no} hours").alias("ts"), "text", "is_end"
        )

    sink = SessionTokens(spark, str(tmp_path / "s"), "secret", Config.only("EMAIL"))
    first = batch(0, [("a", 0, "x@acme.com y@acme.com", False), ("b", 0, "x@acme.com", True)])
    second = batch(1, [("a", 1, "z@acme.com Y@acme.com", False), ("b", 1, "q@acme.com", False)])
    sink(first, 0)
    sink(second, 1)
    sink(second, 1)  # a replayed batch changes nothing
    sink(batch(30, [("a", 2, "new@acme.com", False)]), 2)
    got = {(r.session_id, r.doc_id): r.redacted for r in sink.redacted().collect()}
    assert got == {
        ("a", 0): "[EMAIL_1] [EMAIL_2]", ("b", 0): "[EMAIL_1]", ("a", 1): "[EMAIL_3] [EMAIL_2]", ("b", 1): "[EMAIL_1]", ("a", 2): "[EMAIL_1]",
    }
