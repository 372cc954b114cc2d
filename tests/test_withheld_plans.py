"""The plans of a run of withheld texts are worked out once, however many batches there are."""

from pyspark.sql import functions as F

from veil.catalog.streams import str_withheld
from veil.sources.tables import TABLES as J_TABLES
from veil.streaming import jobs as J


def test_plans_and_batches_do_not_read_the_events_again(spark, tmp_path, monkeypatch):
    rows = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 4000).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("p"), "id").alias("props"),
    )
    for name in J_TABLES:
        rows.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    seen = []
    plain = J.WithheldOverLimit.__call__

    def call(self, batch, n):
        seen.extend(f for df in (batch, self.limits) for f in df.inputFiles() if "events.parquet" in f)
        return plain(self, batch, n)

    monkeypatch.setattr(J.WithheldOverLimit, "__call__", call)
    shown = {r.event_id: r.shown for r in str_withheld(spark, str(tmp_path / "in")).collect()}
    assert not seen
    used, want = {}, {}
    limits = {0: 70, 1: 90}  # 150 - 100 + 20, 190 - 100
    for n in range(600):
        want[n] = "p" if used.get(n % 3, 0) < limits.get(n % 3, 1 << 60) else "no"
        used[n % 3] = used.get(n % 3, 0) + 1 + n % 3
    assert {n: "p" if s == f"p{n}" else "no" for n, s in shown.items()} == want
    assert set(want.values()) == {"p", "no"}
