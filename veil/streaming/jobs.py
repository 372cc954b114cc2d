"""Streams: detection on arrival, tokens that last a session, usage windows, limits, request and reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.crypto import blind_index, derive_key, encrypt, hmac_pads
from veil.operators.inrow import finding_rows, findings_in_row
from veil.operators.tokens import assign_tokens, redact
from veil.session import materialize
from veil.sources.sinks import scratch


def detect_stream(texts: DataFrame, config: Config, keys: list[str]) -> DataFrame:
    """Resolved and graded findings of a stream of texts, names included: the whole chain inside the row, without state.

    The same rows as ``plans.redact.find`` gives for a table with the sweep off; known values of a session need more than
    one text, so with the sweep on this is refused.
    """
    if config.sweep:
        raise ValueError("the sweep needs all texts of a session: use Config(sweep=False)")
    return finding_rows(findings_in_row(texts, config), keys)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into parquet and return it as a table."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, name + "-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Snapshots:
    """Tables under one folder, written anew for each batch: a replayed batch overwrites its own output."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        """Numbers of the batches that a table has."""
        path, fs = self._folder(name)
        if not fs.exists(path):
            return []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path) if x.getPath().getName().startswith("batch="))

    def _snapshot(self, name: str, schema: str, before: int) -> DataFrame:
        known = [b for b in self._batches(name) if b < before]
        if not known:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={known[-1]}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")

    def _forget(self, names: tuple[str, ...], batch_id: int) -> None:
        """Delete the snapshots before the last two."""
        for name in names:
            path, fs = self._folder(name)
            for old in [b for b in self._batches(name) if b < batch_id][:-1]:
                fs.delete(path.suffix(f"/batch={old}"), True)


class SessionTokens(Snapshots):
    """Masks a stream of ``session_id, doc_id, ts, text, is_end`` with tokens that stay the same all session long.

    Used as a ``foreachBatch`` sink that runs the whole chain on arrival: rules, labels, names, tables, hidden forms, grading,
    overlaps. A session starts anew after an end marker, or when it was silent for ``ttl``, wherever in a batch that happens:
    by its own texts' times, not by how the stream was cut nor by other sessions. Each spell of a session, its ``life``, is
    named by its first text, so a token of a life never stands for two values, also when the session's state was dropped.

    The state is a compacted snapshot for each batch: tokens of sessions that still live, and each session's last time. A batch
    reads the snapshot before it and writes its own, so work follows the batch and what lives, and a replayed batch overwrites
    its own output. Values are sealed; they are joined by their keyed fingerprint. Snapshots before the last two are deleted,
    and with them the values of sessions that ended or fell silent. Silence is measured against the latest time that another
    session supports within ``lead``, and that has come by the clock: a few texts stamped far ahead end no session but their own.
    """

    OUTLIERS, FOUND = 2, "_findings"

    def __init__(self, spark: SparkSession, root: str, secret: str, config: Config | None = None, ttl: str = "24 hours", lead: str = "7 days"):
        super().__init__(spark, root)
        self.ttl, self.lead = ttl, lead
        self.config = config or Config(sweep=False)
        if self.config.sweep:
            raise ValueError("the sweep needs all texts of a session: use Config(sweep=False)")
        self.ipad, self.opad = (F.lit(p) for p in hmac_pads(derive_key("blind", "stream", secret)))
        self.key = F.lit(derive_key("enc", "stream", secret).hex())

    TOKENS = "session_id string, life string, type string, norm_ix string, ordinal bigint, token string, canonical string"
    SESSIONS = "session_id string, life string, last_ts timestamp, ended boolean"
    LIFE = ["life", "doc_id"]

    def live_tokens(self) -> DataFrame:
        """Tokens of the sessions that live after the last batch: values sealed."""
        return self._snapshot("tokens", self.TOKENS, 1 << 62)

    def redacted(self) -> DataFrame:
        """Masked texts of all batches, with the session's life they fell in."""
        if not self._batches("redacted"):
            return self.spark.createDataFrame([], "session_id string, life string, doc_id bigint, redacted string, batch bigint")
        return self.spark.read.parquet(f"{self.root}/redacted")

    def _lives(self, texts: DataFrame, before: DataFrame) -> DataFrame:
        """Texts with ``life``: the session's name with the time and id of the text that its current spell began with."""
        joined = texts.join(before.withColumnsRenamed({"life": "_life", "last_ts": "_last", "ended": "_ended"}), "session_id", "left")
        order = Window.partitionBy("session_id").orderBy("ts", "doc_id")
        first = F.row_number().over(order) == 1
        earlier = F.when(first, F.col("_last")).otherwise(F.lag("ts").over(order))
        ended = F.when(first, F.col("_ended")).otherwise(F.lag("is_end").over(order))
        anew = F.coalesce(ended, F.lit(False)) | F.coalesce(F.col("ts") - earlier > F.expr(f"interval {self.ttl}"), F.lit(False)) | (first & F.col("_life").isNull())
        named = F.when(F.col("_anew"), F.concat_ws("#", "session_id", F.unix_micros("ts").cast("string"), F.col("doc_id").cast("string")))
        life = F.coalesce(F.last(named, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_life")
        return joined.withColumn("_anew", anew).withColumn("life", life).drop("_life", "_last", "_ended", "_anew")

    def _clock(self, sessions: DataFrame):
        """The latest last time of a session that another one supports, leaving a few at most out; None without sessions."""
        latest = [r[0] for r in sessions.where("last_ts is not null").orderBy(F.desc("last_ts")).select(F.unix_micros("last_ts")).limit(self.OUTLIERS + 1).collect()]
        lead = self.spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {self.lead}"))).first()[0]
        for t, before in zip(latest, latest[1:]):
            if t - before <= lead:
                return t
        return latest[-1] if latest else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        config = self.config
        sessions = self._snapshot("sessions", self.SESSIONS, batch_id)
        given = self._snapshot("tokens", self.TOKENS, batch_id)
        texts = batch if self.FOUND in batch.columns else findings_in_row(batch, config, name=self.FOUND)
        texts = materialize(self._lives(texts.withColumn("session_id", F.col("session_id").cast("string")), sessions))
        kept = finding_rows(texts, self.LIFE, self.FOUND)
        texts = texts.drop(self.FOUND)
        kept = materialize(kept.withColumn("norm_ix", blind_index(F.col("value"), self.ipad, self.opad)))
        live = given.join(texts.select("life").distinct(), "life", "left_semi")
        new = kept.join(live.select("life", "type", "norm_ix"), ["life", "type", "norm_ix"], "left_anti")
        highest = live.groupBy("life", "type").agg(F.max("ordinal").alias("_top"))
        ordinal = F.col("ordinal") + F.coalesce("_top", F.lit(0))
        named = (
            assign_tokens(new, "life", config=config)
            .join(highest, ["life", "type"], "left")
            .withColumn("ordinal", ordinal)
            .withColumn("token", F.concat(F.lit(config.token_prefix), "type", F.lit("_"), F.col("ordinal").cast("string"), F.lit(config.token_suffix)))
            .withColumn("norm_ix", blind_index(F.col("canonical"), self.ipad, self.opad))
            .withColumn("canonical", encrypt(F.col("canonical"), self.key))
            .join(texts.select("life", "session_id").distinct(), "life")
        )
        columns = [c.split()[0] for c in self.TOKENS.split(", ")]
        valid = materialize(live.select(*columns).unionByName(named.select(*columns)))
        tokenised = kept.join(valid.select("life", "type", "norm_ix", "token"), ["life", "type", "norm_ix"])
        done = redact(texts, tokenised, self.LIFE)
        self._write(done.select("session_id", "life", "doc_id", "redacted"), "redacted", batch_id)
        newest = F.struct("ts", "doc_id")
        last = texts.groupBy("session_id").agg(
            F.max_by("life", newest).alias("life"), F.least(F.max("ts"), F.current_timestamp()).alias("last_ts"), F.max_by("is_end", newest).alias("ended")
        )
        known = sessions.select("session_id", F.col("last_ts").alias("_last"))
        last = last.join(known, "session_id", "left").withColumn("last_ts", F.greatest("last_ts", "_last")).drop("_last")
        every = materialize(sessions.join(last.select("session_id"), "session_id", "left_anti").unionByName(last))
        now = self._clock(every)
        if now is not None:
            since = F.least(F.timestamp_micros(F.lit(now)), F.current_timestamp()) - F.expr(f"interval {self.ttl}")
            every = every.where(F.coalesce(F.col("last_ts") >= since, F.lit(True)))
        current = every.where("not coalesce(ended, false)").select("life")
        others = given.join(texts.select("life").distinct(), "life", "left_anti")
        self._write(others.select(*columns).unionByName(valid).join(current, "life", "left_semi").select(*columns), "tokens", batch_id)
        self._write(every, "sessions", batch_id)
        self._forget(("tokens", "sessions"), batch_id)

    def run(self, stream: DataFrame) -> None:
        found = findings_in_row(stream, self.config, name=self.FOUND)  # planned once, not for each batch
        query = (
            found.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def usage_windows(usage: DataFrame, length: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Values masked per tenant and event-time window; what arrives later than ``late`` is left out."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        usage.withWatermark("ts", late)
        .groupBy(span.alias("w"), "tenant")
        .agg(F.sum("used").alias("used"), F.count(F.lit(1)).alias("calls"))
        .select("tenant", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "used", "calls")
    )


def usage_sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same per spell of activity: calls less than ``gap`` apart belong together."""
    return (
        usage.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "tenant")
        .agg(F.sum("used").alias("used"), F.count(F.lit(1)).alias("calls"))
        .select("tenant", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "used", "calls")
    )


def limit_flags(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Running use per tenant against its plan; the state is one number per tenant, summed before the shuffle.

    To be written in update or complete mode: a tenant's next calls are refused once ``over_limit`` is set.
    """
    total = usage.groupBy("tenant").agg(F.sum("used").alias("total"))
    over = (F.col("limit_n") != -1) & (F.col("total") >= F.col("limit_n") + F.col("credits"))
    return total.join(plans.select("tenant", "limit_n", "credits"), "tenant").select("tenant", "total", over.alias("over_limit"))


class WithheldOverLimit(Snapshots):
    """Masked texts of a stream (tenant, ts, redacted, used and ``keys``), withheld once their tenant's use has reached its plan.

    Used as a ``foreachBatch`` sink. Use adds up in the order of ``ts``, ties by ``keys`` and text; the text that reaches the limit
    is still shown, later ones are not. A text waits until another one is ``late`` past it, so texts that arrive out of order by
    at most that are decided as in one batch; those that come later still are decided when they come, after what was decided
    before them. Without time a text is decided first in its batch. Tenants without a plan have no limit, of a tenant's
    several plans the widest counts; use below zero or missing counts as none.

    The state is one number for each tenant with a limit and the texts that wait. Use is summed by minute first; only the
    minute in which a tenant reaches its limit is put in order text by text.
    """

    TOTALS, CLOCK = "tenant string, total bigint", "latest timestamp"

    def __init__(self, spark: SparkSession, root: str, plans: DataFrame, notice: str, late: str = "0 seconds", keys: dict[str, str] | None = None):
        super().__init__(spark, root)
        self.notice, self.late, self.keys = notice, F.expr(f"interval {late}"), list(keys or {})
        self.waiting = ", ".join(["tenant string, ts timestamp, redacted string, used bigint", *(f"{k} {t}" for k, t in (keys or {}).items())])
        limit = F.when(F.min("limit_n") != -1, F.max(F.col("limit_n") + F.col("credits")))
        self.limits = plans.groupBy(F.col("tenant").cast("string").alias("tenant")).agg(limit.alias("_limit")).where("_limit is not null")

    def _steps(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        """Minutes of tenants that have a limit: use before them, and whether it reaches the limit within them."""
        minutes = rows.groupBy("tenant", "_minute").agg(F.sum("used").alias("_used")).join(self.limits, "tenant").join(totals, "tenant", "left")
        so_far = F.sum("_used").over(Window.partitionBy("tenant").orderBy("_minute").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        upto = F.coalesce("total", F.lit(0)) + so_far
        return minutes.select("tenant", "_minute", "_limit", (upto - F.col("_used")).alias("_before"), upto.alias("_upto"))

    def _decided(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        rows = rows.withColumn("_minute", F.coalesce(F.date_trunc("minute", "ts"), F.timestamp_micros(F.lit(-(1 << 62)))))
        steps = self._steps(rows, totals).where("_upto >= _limit").withColumn("_edge", F.expr("_before < _limit"))
        met = rows.join(steps, ["tenant", "_minute"], "left")
        order = Window.partitionBy("tenant").orderBy("ts", *self.keys, "redacted").rowsBetween(Window.unboundedPreceding, -1)
        edge = met.where("_edge").withColumn("_before", F.col("_before") + F.coalesce(F.sum("used").over(order), F.lit(0)))
        shown = F.when(F.coalesce(F.expr("_before >= _limit"), F.lit(False)), F.lit(self.notice)).otherwise(F.col("redacted"))
        return met.where("not coalesce(_edge, false)").unionByName(edge).select("tenant", "ts", *self.keys, shown.alias("shown"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        totals = self._snapshot("totals", self.TOTALS, batch_id)
        columns = [c.split()[0] for c in self.waiting.split(", ")]
        come = batch.withColumn("tenant", F.col("tenant").cast("string")).withColumn("used", F.greatest(F.coalesce("used", F.lit(0)), F.lit(0)).cast("bigint"))
        rows = materialize(come.select(*columns).unionByName(self._snapshot("waiting", self.waiting, batch_id)))
        clock = self._snapshot("clock", self.CLOCK, batch_id).unionByName(rows.select(F.col("ts").alias("latest"))).agg(F.max("latest").alias("latest"))
        clock = materialize(clock)
        past = F.coalesce(F.col("ts") <= F.col("latest") - self.late, F.lit(True))
        timed = rows.crossJoin(F.broadcast(clock)).withColumn("_past", past).drop("latest")  # one row
        ready = timed.where("_past").drop("_past")
        self._write(self._decided(ready, totals), "shown", batch_id)
        used = ready.join(self.limits.select("tenant"), "tenant", "left_semi").groupBy("tenant").agg(F.sum("used").alias("total")).unionByName(totals)
        self._write(used.groupBy("tenant").agg(F.sum("total").alias("total")), "totals", batch_id)
        self._write(timed.where("not _past").drop("_past"), "waiting", batch_id)
        self._write(clock, "clock", batch_id)
        self._forget(("totals", "waiting", "clock"), batch_id)

    def shown(self, final: bool = False) -> DataFrame:
        """What was decided, and with ``final`` also what waits, as it would be if nothing more came."""
        done = self.spark.read.parquet(f"{self.root}/shown").select("tenant", "ts", *self.keys, "shown")
        if not final:
            return done
        now = 1 << 62
        return done.unionByName(self._decided(self._snapshot("waiting", self.waiting, now), self._snapshot("totals", self.TOTALS, now)))

    def run(self, stream: DataFrame) -> None:
        stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregation over what is there now; each batch replaces the table."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, name + "-state")

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/latest")

    query = stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/latest")


def pair_replies(requests: DataFrame, replies: DataFrame, patience: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Each reply with the request it answers, of the same session. Requests are forgotten after ``patience``.

    ``requests``: session_id, id, method, asked_ts. ``replies``: session_id, id, result, reply_ts.
    """
    asked = requests.withWatermark("asked_ts", "10 minutes").alias("q")
    answered = replies.withWatermark("reply_ts", late).withColumnsRenamed({"id": "reply_id", "session_id": "reply_session"}).alias("r")
    on = F.expr(f"id = reply_id AND session_id = reply_session AND reply_ts >= asked_ts AND reply_ts <= asked_ts + interval {patience}")
    return asked.join(answered, on, "inner").select("session_id", "id", "method", "result", "asked_ts", "reply_ts")


def answered_once(requests: DataFrame, replies: DataFrame, patience: str = "1 hour") -> DataFrame:
    """``pair_replies``, but a request is answered once: replies that repeat one are dropped.

    Replies may be late by ``patience``, so every reply that can still meet its request falls within the watermark of the first.
    The one that arrives first counts; the order of replies that arrive together is not defined.
    """
    pairs = pair_replies(requests, replies, patience, late=patience)
    asked = (F.col("asked_ts") + F.expr("interval 0 seconds")).alias("asked_ts")  # the reply's time is the one time of a pair
    pairs = pairs.select("session_id", "id", "method", "result", asked, "reply_ts")
    return pairs.dropDuplicatesWithinWatermark(["session_id", "id", "asked_ts"])
