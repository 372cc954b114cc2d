"""The chain inside the row gives what the grouped operators give, on tables and on streams."""

import random

import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.operators.encoded import drop_in_base64
from veil.operators.inrow import finding_rows, findings_in_row, scan
from veil.operators.resolve import select_findings
from veil.operators.score import score
from veil.plans.redact import candidates
from veil.streaming.jobs import detect_stream, run_available

KEYS = ["session_id", "doc_id"]
COLUMNS = [*KEYS, *"type start_at end_at value surface via before after gathered points confidence level reason finding_id".split()]
PIECES = [
    "Dear Mr John Smith, ", "JOHN SMITH and J.R.R. Tolkien ", "Name: Oliver Testcase. ", "Mary Anne Miller ", "mail u1@acme.com ", "order 0821234567 ", "call 0821234567 ", "3505 4121 6080 5306 ",
    "u2%40acme.com/x ", "bob [at] acme [dot] org ", "full_name\temail\nJane Doe\tj@acme.com\n\n", "| Date of birth | 1951-06-21 |\n", "<td>Name</td><td>Ann Lee</td> ", "dGhlIG1haWwgaXMgam9obkBhY21lLmNvbSBhbmQgbW9yZQ== ",
    "A" * 70 + "0821234567" + "B" * 70 + " ", "password: hunter2hunter2 ", "née Johnson ", "12 Kloof Street, Cape Town, 7700 ", "IPV 192.168.0.1 ", "[PERSON_1] ", "MARY JONES MARY ", "plain words here. ", "日本 \U0001f600 ",
]


def grouped(corpus, config):
    found = candidates(corpus, config, KEYS)
    if config.encoded:
        found = drop_in_base64(found, corpus, KEYS)
    return select_findings(score(found), KEYS, config)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


def texts(spark, n, seed=1):
    r = random.Random(seed)
    made = [("s", i, "".join(r.choice(PIECES) for _ in range(r.randrange(1, 14)))) for i in range(n)] + [("s", n, None), ("s", n + 1, ""), ("s", n + 2, "nothing")]
    return spark.createDataFrame(made, "session_id string, doc_id bigint, text string")


CONFIGS = [
    Config.profile("strict", person=True, sweep=False),
    Config.profile("strict", person=True, sweep=False, person_mode="strict", allow_terms=("u1@acme.com", "John Smith"), instance_threshold={"EMAIL": 2, "PERSON": 2}, min_confidence=0.6),
    Config.only("EMAIL", "PHONE", encoded=True),
]


@pytest.mark.parametrize("config", CONFIGS)
def test_equal_to_the_grouped_operators(spark, config):
    corpus = texts(spark, 150)
    want = rows(grouped(corpus, config))
    assert rows(finding_rows(findings_in_row(corpus, config), KEYS)) == want
    assert len(want) > 40


def test_names_on_a_plain_stream(spark, tmp_path):
    corpus = texts(spark, 60, seed=4)
    corpus.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = detect_stream(stream, CONFIGS[0], KEYS)
    assert rows(run_available(found, "inrow")) == rows(grouped(corpus, CONFIGS[0]))


def test_nothing_is_shuffled(spark):
    plan = finding_rows(findings_in_row(texts(spark, 3), CONFIGS[0]), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_many_findings_in_one_text(spark):
    """Thousands of findings in a row, overlapping ones too, against the windows."""
    body = " ".join(f"u{i}@acme.com JOHN SMITH" if i % 3 else f"John Smith 08212{i:05d}" for i in range(3_000))
    corpus = spark.createDataFrame([("s", 0, body)], "session_id string, doc_id bigint, text string")
    config = Config.only("EMAIL", "PHONE", "PERSON")
    assert rows(finding_rows(findings_in_row(corpus, config), KEYS)) == rows(grouped(corpus, config))


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_scan(spark, n):
    xs = [random.Random(n).randrange(1000) for _ in range(n)]
    got = spark.createDataFrame([(xs,)], "xs array<int>").select(scan(F.col("xs"), F.lit(-1), F.greatest)).first()[0]
    want = [max(xs[: i + 1]) for i in range(n)]
    assert got == want
