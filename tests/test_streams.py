"""Streams give the same however they are cut; nothing of an ended session is kept."""

import pathlib

import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.streaming.jobs import SessionTokens, WithheldOverLimit, answered_once, detect_stream

EVENTS = [  # session, text number, hour, text, whether the session ends here
    ("a", 0, 0, "x@acme.com y@acme.com", False), ("b", 1, 0, "x@acme.com", True), ("a", 2, 1, "z@acme.com Y@acme.com", False),
    ("b", 3, 2, "q@acme.com x@acme.com", False), ("b", 4, 3, "x@acme.com", True), ("b", 5, 4, "Name: Mary Miller, r@acme.com", False),
    ("a", 6, 30, "new@acme.com", False), ("c", 7, 31, "password: hunter2hunter2", False), ("a", 8, 32, "x@acme.com", False), ("c", 9, 60, "n@acme.com", False),
    ("c", 10, 61, "password: hunter2hunter2", True),
]
WANT = {
    0: "[EMAIL_1] [EMAIL_2]", 1: "[EMAIL_1]", 2: "[EMAIL_3] [EMAIL_2]", 3: "[EMAIL_1] [EMAIL_2]", 4: "[EMAIL_2]", 5: "Name: [PERSON_1], [EMAIL_1]",
    6: "[EMAIL_1]", 7: "password: [SECRET_1]", 8: "[EMAIL_2]", 9: "[EMAIL_1]", 10: "password: [SECRET_1]",
}


@pytest.mark.parametrize("cut", [1, 4])
def test_tokens_however_the_stream_is_cut(spark, tmp_path, cut):
    sink = SessionTokens(spark, str(tmp_path / "s"), "secret", Config(detectors={"PERSON": True}, sweep=False))
    size = -(-len(EVENTS) // cut)
    for n in range(cut):
        rows = [(s, d, h, t, e) for s, d, h, t, e in EVENTS[n * size : (n + 1) * size]]
        batch = spark.createDataFrame(rows, "session_id string, doc_id bigint, h int, text string, is_end boolean")
        sink(batch.withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)")).drop("h"), n)
    assert {r.doc_id: r.redacted for r in sink.redacted().collect()} == WANT
    # all sessions have ended or fallen silent, so no value is left in the last snapshot
    assert sink.live_tokens().count() == 0
    stored = b"".join(p.read_bytes() for p in pathlib.Path(tmp_path).rglob("*.parquet"))
    assert b"acme.com" not in stored and b"hunter2" not in stored
    assert len(list((tmp_path / "s" / "tokens").glob("batch=*"))) <= 2


def _tokens_of(spark, root, batches, **kw):
    """Masked texts of some batches of (session, text number, time, text)."""
    sink = SessionTokens(spark, str(root), "secret", Config.only("EMAIL"), **kw)
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame([(s, d, t, x, False) for s, d, t, x in rows], "session_id string, doc_id bigint, ts string, text string, is_end boolean")
        sink(batch.withColumn("ts", F.col("ts").cast("timestamp")), n)
    return {r.doc_id: (r.life, r.redacted) for r in sink.redacted().collect()}


def test_a_token_of_a_life_has_one_value_after_a_silence(spark, tmp_path):
    """Another session's batch lies between, and drops the state of the silent one."""
    done = _tokens_of(spark, tmp_path, [[("a", 0, "2024-01-01", "x@acme.com")], [("b", 1, "2024-01-04", "q@acme.com")], [("a", 2, "2024-01-04", "y@acme.com x@acme.com")]])
    assert done[0][1] == "[EMAIL_1]" and done[2][1] == "[EMAIL_1] [EMAIL_2]"
    assert done[0][0] != done[2][0]


def test_a_text_stamped_far_ahead_ends_no_other_session(spark, tmp_path):
    rows = [
        [("a", 0, "2024-01-01 00:00:00", "x1@acme.com"), ("b", 1, "2024-01-01 00:00:30", "z@acme.com"), ("c", 2, "2024-01-01 00:00:40", "w@acme.com")],
        [("b", 3, "2100-01-01 00:00:00", "z@acme.com")],
        [("a", 4, "2024-01-01 00:01:00", "y2@acme.com x1@acme.com"), ("b", 5, "2024-01-01 00:02:00", "z2@acme.com")],
    ]
    done = _tokens_of(spark, tmp_path / "x", rows)
    assert done[4] == (done[0][0], "[EMAIL_2] [EMAIL_1]")
    assert done[2][1] == "[EMAIL_1]"
    # one text after the other gives the same as all in one batch, but for what the far stamp itself does to its session
    one = _tokens_of(spark, tmp_path / "y", [[r for batch in rows for r in batch]])
    assert {k: v for k, v in one.items() if k in (0, 2, 4)} == {k: v for k, v in done.items() if k in (0, 2, 4)}


def test_twenty_cuts_give_what_one_gives(spark, tmp_path):
    rows = [("abcd"[i % 4], i, f"2024-01-{1 + i * i // 40:02d} {i % 24:02d}:00:00", f"u{i % 7}@acme.com and U{i % 5}@acme.com") for i in range(20)]
    rows.sort(key=lambda r: (r[2], r[1]))
    assert _tokens_of(spark, tmp_path / "many", [[r] for r in rows]) == _tokens_of(spark, tmp_path / "one", [rows])


def test_the_sweep_is_refused_where_it_cannot_run(spark):
    texts = spark.createDataFrame([(0, "x")], "doc_id int, text string")
    with pytest.raises(ValueError):
        detect_stream(texts, Config(sweep=True), ["doc_id"])
    with pytest.raises(ValueError):
        SessionTokens(spark, "unused", "secret", Config())


@pytest.mark.parametrize("cut", [1, 3])
def test_texts_are_withheld_over_the_limit(spark, tmp_path, cut):
    plans = spark.createDataFrame([("a", 5, 1), ("b", -1, 0)], "tenant string, limit_n bigint, credits bigint")
    rows = [("a", i, f"a{i}", 2) for i in range(6)] + [("b", i, f"b{i}", 9) for i in range(6)] + [("c", 0, "c0", 1)]
    rows.sort(key=lambda r: r[1])
    sink = WithheldOverLimit(spark, str(tmp_path / "w"), plans, "withheld")
    size = -(-len(rows) // cut)
    for n in range(cut):
        batch = spark.createDataFrame(rows[n * size : (n + 1) * size], "tenant string, m int, redacted string, used bigint")
        sink(batch.withColumn("ts", F.timestamp_seconds("m")).drop("m"), n)
    shown = sorted(r.shown for r in sink.shown().collect() if r.tenant == "a")
    assert shown == ["a0", "a1", "a2", "withheld", "withheld", "withheld"]
    assert sink.shown().where("tenant <> 'a' and shown = 'withheld'").count() == 0


LATE = [  # tenant, second, id, use; as they arrive: out of order by at most 100 seconds
    ("a", 0, 0, 2), ("a", 90, 1, 2), ("b", 95, 2, 7), ("a", 30, 3, 1), ("a", 30, 4, 1), ("a", 120, 5, 0), ("a", 60, 6, 3), ("a", 200, 7, 1),
    ("a", 130, 8, None), ("b", 210, 9, 9), ("a", 300, 10, 1), ("c", 310, 11, -5), ("c", 312, 12, 6), ("c", 312, 13, 1),
]
LIMITS = {"a": 6, "c": 6}


def _plain(rows):
    """Shown ids by a loop over all texts in order of time."""
    used, shown = {}, {}
    for tenant, _, n, use in sorted(rows, key=lambda r: (r[1], r[2])):
        shown[n] = "withheld" if used.get(tenant, 0) >= LIMITS.get(tenant, 1 << 60) else f"t{n}"
        used[tenant] = used.get(tenant, 0) + max(use or 0, 0)
    return shown


@pytest.mark.parametrize("cut", [1, 3, 14])
def test_late_texts_are_withheld_in_order_of_time(spark, tmp_path, cut):
    plans = spark.createDataFrame([("a", 5, 1), ("b", -1, 0), ("c", 6, 0), ("c", 2, 0)], "tenant string, limit_n bigint, credits bigint")
    sink = WithheldOverLimit(spark, str(tmp_path / "w"), plans, "withheld", "100 seconds", {"id": "int"})
    size = -(-len(LATE) // cut)
    for n in range(cut):
        rows = [(t, s, i, f"t{i}", u) for t, s, i, u in LATE[n * size : (n + 1) * size]]
        batch = spark.createDataFrame(rows, "tenant string, s int, id int, redacted string, used bigint")
        sink(batch.withColumn("ts", F.timestamp_seconds("s")).drop("s"), n)
        if n == cut - 1:  # a replayed batch changes nothing
            sink(batch.withColumn("ts", F.timestamp_seconds("s")).drop("s"), n)
    assert {r.id: r.shown for r in sink.shown(final=True).collect()} == _plain(LATE)
    assert sink.shown().count() < len(LATE)
    assert len(list((tmp_path / "w" / "totals").glob("batch=*"))) <= 2


def test_withholding_without_texts_times_or_tenants(spark, tmp_path):
    schema = "tenant string, ts timestamp, redacted string, used bigint"
    plans = spark.createDataFrame([("a", 1, 0)], "tenant string, limit_n bigint, credits bigint")
    sink = WithheldOverLimit(spark, str(tmp_path / "w"), plans, "withheld")
    sink(spark.createDataFrame([], schema), 0)
    sink(spark.createDataFrame([("a", None, "x", 1), (None, None, "y", 5), (None, None, "y", 5), ("a", None, None, 1)], schema), 1)
    assert sorted(str(r.shown) for r in sink.shown().collect()) == ["None", "withheld", "y", "y"]


def test_a_repeated_reply_gives_one_row_however_it_arrives(spark, tmp_path):
    q = [("s", 1, "tools/call", 0), ("s", 2, "tools/list", 0), ("t", 1, "tools/call", 0)]
    r = [("s", 1, "one", 60), ("s", 1, "one", 1200), ("s", 2, "two", 4000), ("t", 1, "uno", 30), ("t", 1, "uno", 30), (None, 1, "x", 10)]
    for n, reply in enumerate(r):  # one file each, so each reply is a batch of its own
        spark.createDataFrame([reply], "session_id string, id int, result string, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    spark.createDataFrame(q, "session_id string, id int, method string, t int").write.parquet(str(tmp_path / "q"))
    asked = spark.readStream.schema("session_id string, id int, method string, t int").parquet(str(tmp_path / "q"))
    replies = spark.readStream.schema("session_id string, id int, result string, t int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    pairs = answered_once(asked.withColumn("asked_ts", F.timestamp_seconds(F.col("t") + 1704067200)).drop("t"), replies.withColumn("reply_ts", F.timestamp_seconds(F.col("t") + 1704067200)).drop("t"))
    query = pairs.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((x.session_id, x.id, x.result) for x in spark.read.schema(pairs.schema).parquet(str(tmp_path / "o")).collect())
    assert got == [("s", 1, "one"), ("t", 1, "uno")]
