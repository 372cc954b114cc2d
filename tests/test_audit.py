"""Facts that add up, and sealed rows whose keys change readers."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from veil.functions import crypto as C
from veil.operators import audit as A
from veil.operators import envelope as E


def test_sketches_of_days_add_up(spark):
    rows = spark.range(30_000).select((F.col("id") % 5).alias("day"), F.lit("EMAIL").alias("type"), F.concat(F.lit("U"), (F.col("id") % 9_000).cast("string")).alias("value"))
    facts = A.distinct_sketches(rows.union(rows.select("day", "type", F.lower("value"))), ["day"])
    assert facts.count() == 5
    total = A.distinct_over(facts, ["type"]).first()
    assert abs(total.distinct_values - 9_000) <= 9_000 * 0.065 and total.occurrences == 60_000
    two = A.distinct_over(facts.where("day in (1, 3)"), []).first()
    assert abs(two.distinct_values - 3_600) <= 3_600 * 0.065


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "day int, type string, value string")
    assert A.distinct_over(A.distinct_sketches(empty, ["day"]), ["type"]).count() == 0
    nulls = spark.createDataFrame([(None, "EMAIL", None), (None, "EMAIL", "x")], "day int, type string, value string")
    row = A.distinct_over(A.distinct_sketches(nulls, ["day"]), ["type"]).first()
    assert (row.distinct_values, row.occurrences) == (1, 2)


def test_keys_rotate_and_rows_stay(spark):
    (public, private), (new_public, new_private) = C.rsa_pair(spark), C.rsa_pair(spark)
    opened, wrapped = E.new_keys(spark, ["a", "b", "a"], public)
    rows = spark.createDataFrame([("a", "x@acme.com", 1), ("b", "", 2), ("c", "nobody", 3), (None, "none", 4), ("a", None, 5)], "tenant string, value string, n int")
    sealed = E.seal_rows(rows, opened, "value")
    held = {r.n: r for r in sealed.collect()}
    assert held[3].value is None and held[3].key_id is None and held[4].value is None and "acme" not in held[1].value
    again = E.rotate_keys(wrapped, private, new_public)
    assert {r.key_id for r in again.collect()} == {r.key_id for r in wrapped.collect()} and again.count() == 2
    clear = {r.n: r.value for r in E.open_rows(sealed, E.open_keys(again, new_private), "value").collect()}
    assert clear == {1: "x@acme.com", 2: "", 3: "", 4: "", 5: ""}
    with pytest.raises(Py4JJavaError):
        E.open_keys(again, private)
