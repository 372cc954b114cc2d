"""Every registered query agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import cell
from veil.sources.tables import TABLES

FOLDER = os.environ.get("VEIL_TEST_DIR", "/root/testdata/sf0.001")
HEAVY = {"redact_corpus"}  # covered by test_pipeline and test_lengths
HEAVY |= {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}  # have tests of their own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in HEAVY])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert name in entry.oracle_sql(), "a query without SQL needs a test of its own"
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
