"""User rules with validators: columns anywhere, pandas UDFs where matches are rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veil import Config
from veil.operators.inrow import findings_in_row
from veil.operators.rules import register_rule
from veil.plans.redact import find

TEXTS = [("s", 0, "ref AB-12 and AB-13"), ("s", 1, "AB-22, ab-24"), ("s", 2, None), ("s", 3, "")]


def found(spark, config):
    corpus = spark.createDataFrame(TEXTS, "session_id string, doc_id int, text string")
    return sorted((r.doc_id, r.type, r.value, r.via) for r in find(corpus, config).collect())


def even(v):
    return F.right(v, F.lit(1)).cast("int") % 2 == 0


def even_in_python(v):
    @F.pandas_udf("boolean")
    def judge(values: pd.Series) -> pd.Series:
        return values.str[-1].astype(int) % 2 == 0

    return judge(v)


@pytest.mark.parametrize("validate,arrow", [(even, False), (even_in_python, True)])
def test_validators(spark, validate, arrow):
    config = register_rule(Config.only(), "REF", "AB-[0-9]{2}", validate, arrow=arrow)
    assert found(spark, config) == [(0, "REF", "AB-12", "custom"), (1, "REF", "AB-22", "custom")]


def test_evidence_flags_and_broken_patterns(spark):
    config = register_rule(Config.only(), "REF", "AB-[0-9]{2}", even, via="checksum", flags="i")
    config = register_rule(config, "BROKEN", "(unclosed")
    assert found(spark, config) == [(0, "REF", "AB-12", "checksum"), (1, "REF", "AB-22", "checksum"), (1, "REF", "ab-24", "checksum")]


def test_python_validators_are_refused_in_the_row(spark):
    config = register_rule(Config.only(), "REF", "AB-[0-9]{2}", even_in_python, arrow=True)
    with pytest.raises(ValueError):
        findings_in_row(spark.createDataFrame(TEXTS, "session_id string, doc_id int, text string"), config)


def test_kind_of_a_builtin_rule_is_judged_whole(spark):
    """The built-in address goes on behind what the pattern alone would take."""
    corpus = spark.createDataFrame([("s", 0, "ab.33@mail1.example.com nted. clown"), ("s", 1, "to ab.33@mail1.example.com"), ("s", 2, "ab.34@mail1.example.com")], "session_id string, doc_id int, text string")
    config = register_rule(Config.only("EMAIL"), "STAFF", r"[a-z]+\.[0-9]{2}@mail[0-9]\.example\.com", lambda v: F.contains(v, F.lit(".33@")), of="EMAIL")
    got = sorted((r.doc_id, r.type, r.value) for r in find(corpus, config).collect())
    assert got == [(0, "EMAIL", "ab.33@mail1.example.com nted. clown"), (1, "STAFF", "ab.33@mail1.example.com"), (2, "EMAIL", "ab.34@mail1.example.com")]
