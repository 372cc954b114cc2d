"""Few findings or tenants go to the texts, not the texts to them; what many mention is read once."""

import pytest
from pyspark.sql import functions as F

from veil.config import Config
from veil.operators.guard import judged, mentioned, withhold
from veil.operators.spans import running_starts
from veil.operators.tokens import redact, rehydrate
from veil.plans.redact import find


@pytest.fixture
def unsized(spark):
    """No join is a broadcast unless the code says so."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


TEXTS = [("s", 0, "to ab@acme.com"), ("s", 1, "nothing")]


def test_texts_stay_in_place(unsized):
    texts = unsized.createDataFrame(TEXTS, "session_id string, doc_id int, text string")
    edits = unsized.createDataFrame([("s", 0, 3, 14, "[EMAIL_1]")], "session_id string, doc_id int, start_at int, end_at int, token string")
    keys = ["session_id", "doc_id"]
    done = redact(texts, edits, keys)
    assert joins(done) and sorted(r.redacted for r in done.collect()) == ["nothing", "to [EMAIL_1]"]
    tokens = unsized.createDataFrame([("s", "[EMAIL_1]", "ab@acme.com")], "session_id string, token string, canonical string")
    sites = unsized.createDataFrame([], "session_id string, token string, surface string, before string, after string, site_no int")
    back = rehydrate(done.select(*keys, "redacted"), tokens, sites, keys)
    assert joins(back) and sorted(r.restored for r in back.collect()) == ["nothing", "to ab@acme.com"]


def test_tenants_that_ran_out_go_to_the_texts(unsized):
    masked = unsized.createDataFrame([("s", 0, "x"), ("t", 1, "y"), (None, 2, "z")], "session_id string, doc_id int, redacted string")
    quota = unsized.createDataFrame([("s", True), ("t", False)], "tenant string, paused boolean")
    shown = withhold(masked, quota, "session_id", "no more")
    assert joins(shown) and {r.doc_id: r.shown for r in shown.collect()} == {0: "no more", 1: "y", 2: "z"}


def test_a_file_that_many_mention_is_read_once(spark):
    prompts = spark.createDataFrame([(i, "see @f and a@b") for i in range(40)] + [(40, "me@acme.com @g, @none")], "prompt_id int, prompt string")
    files = spark.createDataFrame([("f", 9, "x@acme.com X@acme.com"), ("g", 9, "none"), ("h", 9, "y@acme.com")], "path string, size int, content string")
    read = []

    def found(texts, keys):
        read.append(texts.count())
        return find(texts, Config.only("EMAIL", sweep=False), keys)

    got = {r.prompt_id: r for r in judged(mentioned(prompts, files, ["prompt_id"], found), prompts, ["prompt_id"]).collect()}
    assert read == [41, 2]
    assert all(got[i].verdict == "block" and [(s["where"], s.n) for s in got[i].summary] == [("@f", 2)] for i in range(40))
    assert [(s["where"], s.n) for s in got[40].summary] == [("your prompt", 1)]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 300, 5000])
def test_offsets_of_any_number(spark, n):
    row = spark.range(1).select(running_starts(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 5).cast("int"))).alias("s")).first()
    want = [0]
    for i in range(1, n):
        want.append(want[-1] + i % 5)
    assert row.s == want
