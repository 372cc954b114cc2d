"""Streaming jobs over the sample tables, run to the end of what is there."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from veil.catalog.audit import PLANS, USAGE
from veil.catalog.base import EMAIL_RE2, query, re2, spans_out, spans_sql, view
from veil.catalog.records import METHOD
from veil.catalog.redaction import CONV, NOTICE, masked_sql, token_steps
from veil.catalog.scoring import LEVEL_SQL, NUMBERS, scored_sql
from veil.catalog.views import CONTEXT, DOCS
from veil.config import Config
from veil.operators import rules as R
from veil.session import materialize
from veil.sources.sinks import scratch
from veil.sources.tables import register, table
from veil.sources.text import read_ndjson_stream
from veil.streaming import jobs as J


def stream_of(spark, folder, name):
    """A table as a stream, be it one file or a folder of files: the pattern matches its name alone, and Spark lists either."""
    register(spark, folder)
    stream = spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def usage_stream(spark, folder):
    return stream_of(spark, folder, "events").select(F.col("user_id").alias("tenant"), "ts", (F.col("event_id") % 3 + 1).alias("used"))


@query("src_ndjson_stream", f"SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'r-' || cast(event_id AS string) ELSE cast(event_id AS string) END AS id, {METHOD} AS method, props AS params FROM events WHERE event_id % 7 <> 0")
def src_ndjson_stream(spark, folder):
    """JSON lines with ids of several kinds, or none; every seventh line is cut off."""
    events = view(spark, folder, f"SELECT event_id, {METHOD} AS method, props FROM events", "event_id")
    rest = ("method", F.col("props").alias("params"))
    named = F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("id")
    line = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(*rest))).when(F.col("event_id") % 5 == 1, F.to_json(F.struct(named, *rest))).otherwise(
        F.to_json(F.struct(F.col("event_id").alias("id"), *rest))
    )
    path = scratch(spark, "lines")
    events.select(F.when(F.col("event_id") % 7 == 0, F.left(line, F.length(line) - 9)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return J.run_available(read_ndjson_stream(spark, path), "ndjson").select("id", "method", "params")


@query("str_detect", spans_sql(DOCS, EMAIL_RE2, "'EMAIL'", "'structural'"))
def str_detect(spark, folder):
    docs = stream_of(spark, folder, "documents").select("doc_id", "text")
    return spans_out(J.run_available(J.detect_stream(docs, Config.only("EMAIL"), ["doc_id"]), "detect"))


@query("str_graded", scored_sql(NUMBERS) + f" SELECT doc_id, cast(start_at AS bigint) AS start_at, type, value, points / 100.0 AS confidence, {LEVEL_SQL} AS level FROM g WHERE points >= 35")
def str_graded(spark, folder):
    """Numbers graded by what stands around them, on arrival."""
    view(spark, folder, "SELECT 1 AS doc_id")
    stream_of(spark, folder, "orders").createOrReplaceTempView("orders_stream")
    texts = spark.sql(CONTEXT.replace("FROM orders", "FROM orders_stream"))
    found = J.run_available(J.detect_stream(texts, Config.only("PHONE", "CREDIT_CARD"), ["doc_id"]), "graded")
    return found.select("doc_id", F.col("start_at").cast("bigint").alias("start_at"), "type", "value", "confidence", "level")


def conversations(spark, folder, is_end="false"):
    view(spark, folder, "SELECT 1 AS doc_id")
    turns = stream_of(spark, folder, "conversations")
    turns.createOrReplaceTempView("conversation_stream")
    sql = CONV.replace("FROM conversations", "FROM conversation_stream").replace("text || CASE", "cast(timestamp_seconds(1700000000 + turn * 60) AS timestamp) AS ts, " + is_end + " AS is_end, text || CASE")
    return spark.sql(sql)


def stream_tokens(spark, folder, **kw):
    tokens = J.SessionTokens(spark, scratch(spark, "session-tokens"), "sample master secret", Config.only("EMAIL"), **kw)
    tokens.run(conversations(spark, folder))
    return tokens


@query(
    "str_tokens",
    token_steps(CONV, ("EMAIL",)) + masked_sql(CONV) + " SELECT cast(session_id AS string) AS session_id, doc_id, redacted FROM masked",
)
def str_tokens(spark, folder):
    """Conversations masked as a stream; the same tokens as in one batch."""
    return stream_tokens(spark, folder).redacted().select("session_id", "doc_id", "redacted")


_TWICE = (
    token_steps(CONV, ("EMAIL",)) + masked_sql(CONV)
    + " SELECT cast(session_id AS string) AS session_id, doc_id, redacted, b AS batch, {again} AS again FROM masked, (VALUES (0), (1)) AS t(b)"
)


def replayed(spark, folder, later: str, is_end: str):
    """The conversations, and then all of them once more some time later."""
    tokens = J.SessionTokens(spark, scratch(spark, "session-tokens"), "sample master secret", Config.only("EMAIL"))
    flat = view(spark, folder, CONV, "session_id", "doc_id")
    for batch_id, shift in ((0, "0 hours"), (1, later)):
        at = F.expr(f"timestamp_seconds(1700000000 + doc_id * 60) + interval {shift}")
        tokens(flat.withColumn("ts", at).withColumn("is_end", F.expr(is_end)), batch_id)
    return tokens.redacted().select("session_id", "doc_id", "redacted", F.col("batch").cast("int").alias("batch"), (F.min("batch").over(Window.partitionBy("life")) > 0).alias("again"))


@query("str_ttl", _TWICE.replace("{again}", "b = 1"))
def str_ttl(spark, folder):
    """Two days later every session starts over: all values are numbered again."""
    return replayed(spark, folder, "48 hours", "false")


@query("str_session_end", _TWICE.replace("{again}", "b = 1 AND session_id % 2 = 0"))
def str_session_end(spark, folder):
    """Even sessions were ended after the first batch and start over; the others keep their tokens."""
    return replayed(spark, folder, "23 hours", "session_id % 2 = 0 AND doc_id = max(doc_id) OVER (PARTITION BY session_id)")


_FMT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def stamped(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df


@query(
    "str_usage_window",
    f"""WITH u AS ({USAGE}), w AS (SELECT tenant, date_trunc('minute', ts) AS a, cast(sum(used) AS bigint) AS used, count(*) AS calls FROM u GROUP BY ALL)
SELECT tenant, {_FMT.format('a')} AS from_ts, {_FMT.format("a + INTERVAL 1 MINUTE")} AS to_ts, used, calls FROM w WHERE a + INTERVAL 1 MINUTE <= date_trunc('milliseconds', (SELECT max(ts) FROM u)) - INTERVAL 10 MINUTE""",
)
def str_usage_window(spark, folder):
    """Closed one-minute windows; the ones the watermark has not passed yet are not out."""
    return stamped(J.run_available(J.usage_windows(usage_stream(spark, folder)), "windows"), "from_ts", "to_ts")


@query(
    "str_usage_sliding",
    f"""WITH u AS ({USAGE}), w AS (SELECT tenant, time_bucket(INTERVAL 5 MINUTE, ts) - m * INTERVAL 5 MINUTE AS a, cast(sum(used) AS bigint) AS used, count(*) AS calls FROM u, (VALUES (0), (1)) AS t(m) GROUP BY ALL)
SELECT tenant, {_FMT.format('a')} AS from_ts, {_FMT.format("a + INTERVAL 10 MINUTE")} AS to_ts, used, calls FROM w WHERE a + INTERVAL 10 MINUTE <= date_trunc('milliseconds', (SELECT max(ts) FROM u)) - INTERVAL 10 MINUTE""",
)
def str_usage_sliding(spark, folder):
    return stamped(J.run_available(J.usage_windows(usage_stream(spark, folder), "10 minutes", "5 minutes"), "sliding"), "from_ts", "to_ts")


@query(
    "str_usage_sessions",
    f"""WITH u AS ({USAGE}), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM u),
s AS (SELECT *, sum(opens) OVER (PARTITION BY tenant ORDER BY ts) AS no FROM n),
w AS (SELECT tenant, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, cast(sum(used) AS bigint) AS used, count(*) AS calls FROM s GROUP BY tenant, no)
SELECT tenant, {_FMT.format('a')} AS from_ts, {_FMT.format('b')} AS to_ts, used, calls FROM w WHERE b <= date_trunc('milliseconds', (SELECT max(ts) FROM u)) - INTERVAL 10 MINUTE""",
)
def str_usage_sessions(spark, folder):
    return stamped(J.run_available(J.usage_sessions(usage_stream(spark, folder)), "spells"), "from_ts", "to_ts")


@query(
    "str_over_limit",
    f"SELECT u.tenant, cast(sum(used) AS bigint) AS total, any_value(limit_n) <> -1 AND sum(used) >= any_value(limit_n + credits) AS over_limit, CASE WHEN any_value(limit_n) <> -1 AND sum(used) >= any_value(limit_n + credits) THEN '{NOTICE}' ELSE 'open' END AS answer FROM ({USAGE}) u JOIN ({PLANS}) p ON p.tenant = u.tenant GROUP BY u.tenant",
)
def str_over_limit(spark, folder):
    """Running use against the plan, and what a tenant's next call is answered."""
    stream = usage_stream(spark, folder)
    flags = J.run_complete(J.limit_flags(stream, spark.sql(PLANS)), "limits")
    return flags.withColumn("answer", F.when(F.col("over_limit"), NOTICE).otherwise("open"))


@query(
    "str_request_reply",
    f"""WITH q AS (SELECT event_id AS id, {METHOD} AS method, ts AS asked_ts FROM events),
r AS (SELECT event_id - 1 AS id, props AS result, ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 SECOND END AS reply_ts FROM events)
SELECT q.id, method, result FROM q JOIN r ON q.id = r.id AND reply_ts >= asked_ts AND reply_ts <= asked_ts + INTERVAL 1 HOUR""",
)
def str_request_reply(spark, folder):
    """Every event asks; the next one answers it, some of them too late."""
    events = stream_of(spark, folder, "events")
    session = (F.col("event_id") % 1 == 0).alias("session_id")
    requests = events.select(session, F.col("event_id").alias("id"), F.expr(METHOD).alias("method"), F.col("ts").alias("asked_ts"))
    delay = F.when(F.col("event_id") % 5 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 0 hours"))
    replies = events.select(session, (F.col("event_id") - 1).alias("id"), F.col("props").alias("result"), (F.col("ts") + delay).alias("reply_ts"))
    return J.run_available(J.pair_replies(requests, replies), "pairs").select("id", "method", "result")


_ALLOWED = f"SELECT tenant, CASE limit_n WHEN -1 THEN -1 ELSE limit_n - 100 END AS limit_n, credits FROM ({PLANS})"


@query(
    "str_withheld",
    f"""WITH u AS (SELECT user_id AS tenant, event_id, ts, props, 1 + event_id % 3 AS used FROM events),
r AS (SELECT *, coalesce(sum(used) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM u)
SELECT cast(r.tenant AS string) AS tenant, event_id, CASE WHEN limit_n <> -1 AND earlier >= limit_n + credits THEN '{NOTICE}' ELSE props END AS shown FROM r JOIN ({_ALLOWED}) p ON p.tenant = r.tenant""",
)
def str_withheld(spark, folder):
    """Texts that arrive up to nine hours late, in batches of five days, withheld in the order of time."""
    events = view(spark, folder, "SELECT user_id AS tenant, event_id, ts, props AS redacted, 1 + event_id % 3 AS used FROM events", "event_id")
    come = F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") * 7 % 10 * 3600
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_batch", F.least(F.floor((come - 1704067200) / (5 * 86400)), F.lit(6)))
    come_in, plans = scratch(spark, "arrived"), materialize(spark.sql(_ALLOWED))  # every batch looks its tenants up: events are read once for that
    rows.write.partitionBy("_batch").parquet(come_in)
    arrived = spark.read.schema(rows.schema).parquet(come_in)
    sink = J.WithheldOverLimit(spark, scratch(spark, "withheld"), plans, NOTICE, "10 hours", {"event_id": "bigint"})
    for n in range(7):
        sink(arrived.where(F.col("_batch") == n).drop("_batch"), n)
    return sink.shown(final=True).select("tenant", "event_id", "shown")


@query(
    "str_answered_once",
    f"""WITH q AS (SELECT event_id AS id, {METHOD} AS method, ts AS asked_ts FROM events),
r AS (SELECT event_id - 1 AS id, props AS result, ts + k * INTERVAL 20 MINUTE AS reply_ts FROM events, (VALUES (0), (1), (2)) AS t(k) WHERE k <= event_id % 3)
SELECT DISTINCT q.id, method, result FROM q JOIN r ON q.id = r.id AND reply_ts >= asked_ts AND reply_ts <= asked_ts + INTERVAL 1 HOUR""",
)
def str_answered_once(spark, folder):
    """The next event answers, some of them two or three times, twenty minutes apart."""
    events = stream_of(spark, folder, "events")
    session = (F.col("event_id") % 1 == 0).alias("session_id")
    requests = events.select(session, F.col("event_id").alias("id"), F.expr(METHOD).alias("method"), F.col("ts").alias("asked_ts"))
    times = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    replies = events.select(session, (F.col("event_id") - 1).alias("id"), F.col("props").alias("result"), "ts", F.explode(times).alias("k"))
    replies = replies.select("session_id", "id", "result", (F.col("ts") + F.make_dt_interval(mins=F.col("k") * 20)).alias("reply_ts"))
    return J.run_available(J.answered_once(requests, replies), "answered").select("id", "method", "result")
