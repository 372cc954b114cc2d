"""Finding ids have 32 bits: unlike values that share one stay apart."""

from pyspark.sql import functions as F

from veil.functions.text import finding_id
from veil.operators.resolve import drop_rejected
from veil.operators.tokens import distinct_findings

KEPT, REJECTED = "fmudfet@acme.com", "egptfvq@acme.com"


def rows(spark):
    found = spark.createDataFrame([("s", 0, 0, v) for v in (KEPT, REJECTED)], "session_id string, doc_id int, start_at int, value string")
    return found.select("*", F.lit("EMAIL").alias("type"), finding_id(F.lit("EMAIL"), F.col("value")).alias("finding_id"))


def test_a_rejected_value_takes_no_other_with_it(spark):
    found = rows(spark)
    assert found.select("finding_id").distinct().count() == 1
    rejected = found.where(F.col("value") == REJECTED).select("finding_id", "value")
    assert [r.value for r in drop_rejected(found, rejected).collect()] == [KEPT]
    assert drop_rejected(found, rejected.select("finding_id")).count() == 0


def test_distinct_findings_keep_both(spark):
    graded = rows(spark).select("*", *[F.lit("x").alias(c) for c in ("level", "confidence", "reason")])
    assert sorted((r.value, r.n) for r in distinct_findings(graded, ["session_id"]).collect()) == [(REJECTED, 1), (KEPT, 1)]
