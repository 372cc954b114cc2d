"""Nested records and chat bodies: masked and restored in shape."""

import json

import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.plans.records import redact_messages, redact_records, rehydrate_records


def test_records_keep_their_shape(spark):
    df = spark.sql(
        "SELECT 1 AS id, named_struct('first_name', 'zorblax', 'age', 3) AS person, array(named_struct('value', 'a@acme.com', 'type', 'work')) AS mails, "
        "map('k', named_struct('note', 'write to Zorblax or a@acme.com')) AS extra, 'x/a@acme.com' AS path"
    )
    done = redact_records(df, ["id"], Config(detectors={"PERSON": True}))
    assert done.redacted.schema.simpleString() == df.schema.simpleString()
    row = done.redacted.first().asDict(recursive=True)
    assert row["person"] == {"first_name": "[PERSON_1]", "age": 3} and row["path"] == "x/a@acme.com"
    assert row["mails"] == [{"value": "[EMAIL_1]", "type": "work"}]
    # what the key declared is found in prose too
    assert row["extra"] == {"k": {"note": "write to [PERSON_1] or [EMAIL_1]"}}
    back = rehydrate_records(done.redacted, ["id"], done.token_map, done.sites)
    assert back.first().asDict(recursive=True)["mails"] == [{"value": "a@acme.com", "type": "work"}]
    assert back.schema.simpleString() == df.schema.simpleString()


def test_chat_bodies(spark):
    block = "struct<type: string, text: string, name: string, input: map<string, string>, content: array<struct<type: string, text: string>>>"
    df = spark.createDataFrame(
        [
            (
                1, [("text", "system for s@acme.com", None, None, None)],
                [
                    ("user", [("text", "I am u@acme.com", None, None, None), ("image", "raw u@acme.com", None, None, None)]),
                    ("assistant", [("tool_use", None, "mailer", {"to": "u@acme.com", "path": "u@acme.com"}, None)]),
                    ("user", [("tool_result", None, None, None, [("text", "sent to U@acme.com"), ("image", "u@acme.com")])]),
                ],
            )
        ],
        f"id int, system array<{block}>, messages array<struct<role: string, content: array<{block}>>>",
    )
    done = redact_messages(df, ["id"], Config.only("EMAIL"))
    row = done.redacted.first().asDict(recursive=True)
    assert done.redacted.schema.simpleString() == df.schema.simpleString()
    said = row["messages"]
    mine = said[0]["content"][0]["text"].removeprefix("I am ")
    assert row["system"][0]["text"].startswith("system for [EMAIL_") and mine.startswith("[EMAIL_") and mine not in row["system"][0]["text"]
    assert said[0]["content"][1]["text"] == "raw u@acme.com"
    assert said[1]["content"][0]["input"] == {"to": mine, "path": "u@acme.com"}
    assert [b["text"] for b in said[2]["content"][0]["content"]] == [f"sent to {mine}", "u@acme.com"]


def test_plain_chat_bodies(spark):
    df = spark.createDataFrame([(1, "be kind to s@acme.com", [("user", "u@acme.com")])], "id int, system string, messages array<struct<role: string, content: string>>")
    row = redact_messages(df, ["id"], Config.only("EMAIL")).redacted.first().asDict(recursive=True)
    assert row["system"].startswith("be kind to [EMAIL_") and row["messages"][0]["content"].startswith("[EMAIL_") and row["messages"][0]["role"] == "user"


def test_records_without_a_schema(spark):
    long = "p" * 300_000 + " a@acme.com \\\\ \\n" + "\\u00e9\\\"" * 20_000
    deep = "[" * 300 + '"b@acme.com"' + "]" * 300
    texts = [
        (1, '{"a":{"b":"x"},"a.b":"a@acme.com","big":12345678901234567890.10,"first_name":"zorblax","name:":"y","t":["Zorblax",{"k":"v:"},"a@acme.com"]}'),
        (2, '"' + long + '"'), (3, deep), (4, "17"), (5, "null"), (6, None), (7, '{"e":"","q":":\\"","z":["",null]}'), (8, '"a@acme.com"'), (9, "[]"),
    ]
    df = spark.createDataFrame(texts, "id int, j string").select("id", F.parse_json("j").alias("v"), F.lit("a@acme.com").alias("also"))
    done = redact_records(df, ["id"], Config(detectors={"PERSON": True}))
    assert done.redacted.schema.simpleString() == df.schema.simpleString()
    plain = {r.id: r.j for r in df.select("id", F.to_json("v").alias("j")).collect()}
    got = {r.id: r.j for r in done.redacted.select("id", F.to_json("v").alias("j")).collect()}
    first = json.loads(got[1])
    assert first["a"] == {"b": "x"} and first["a.b"] == "[EMAIL_1]" and first["t"] == ["[PERSON_1]", {"k": "v:"}, "[EMAIL_1]"]
    assert "12345678901234567890.1" in got[1] and first["first_name"] == "[PERSON_1]"
    assert json.loads(got[2]) == json.loads(plain[2]).replace("a@acme.com", "[EMAIL_1]")
    assert got[3] == plain[3].replace("b@acme.com", "[EMAIL_2]")
    assert {k: got[k] for k in (4, 5, 6, 7, 9)} == {k: plain[k] for k in (4, 5, 6, 7, 9)} and got[8] == '"[EMAIL_1]"'
    back = rehydrate_records(done.redacted, ["id"], done.token_map, done.sites)
    again = {r.id: r.j for r in back.select("id", F.to_json("v").alias("j")).collect()}
    assert all(again[k] == plain[k] for k in (2, 3, 4, 5, 6, 7, 8, 9)) and json.loads(again[1])["a.b"] == "a@acme.com"
    with pytest.raises(ValueError):
        redact_records(df.select("id", F.array("v").alias("vs")), ["id"])
    assert redact_records(df.limit(0), ["id"]).redacted.count() == 0
