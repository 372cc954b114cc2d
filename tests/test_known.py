"""Known values found again in long texts, sessions with very frequent words, and odd spellings."""

from pyspark.sql import functions as F

from veil import Config
from veil.operators.known import sweep

KNOWN = "session_id string, value string, type string, sure boolean"
FOUND = "session_id string, doc_id int, start_at int, end_at int"
TEXTS = "session_id string, doc_id int, text string"
KEYS = ["session_id", "doc_id"]


def places(spark, texts, known, **kw):
    corpus = spark.createDataFrame(texts, TEXTS)
    got = sweep(corpus, spark.createDataFrame([], FOUND), spark.createDataFrame(known, KNOWN), KEYS, Config(), **kw)
    return got.orderBy(*KEYS, "start_at", "end_at", "value")


def test_spellings(spark):
    known = [("s", "Jane Doe", "PERSON", False), ("s", "--AB 12--", "ID", True), ("s", "abc" + "." * 60 + "def", "ID", True), ("t", "Ann Lee", "PERSON", False)]
    texts = [
        ("s", 0, "Jane_Doe, JANE%20DOE in /in/jane-doe12 janedoe.pdf prose jane doe"), ("s", 1, "is --ab 12-- there, ab 12 not"),
        ("s", 2, "ABC" + "." * 60 + "DEF"), ("t", 3, "Jane_Doe"), ("u", 4, "Ann_Lee"), ("s", 5, None), ("s", 6, ""), (None, 7, "Jane_Doe"),
    ]
    got = [(r.doc_id, r.surface, r.value) for r in places(spark, texts, known, kinds=("full", "exact")).collect()]
    assert got == [
        (0, "Jane_Doe", "Jane Doe"), (0, "jane-doe12", "Jane Doe"), (0, "janedoe", "Jane Doe"),
        (1, "--ab 12--", "--AB 12--"), (1, "ab 12", "--AB 12--"), (1, "ab 12", "--AB 12--"),
        (2, "ABC" + "." * 60 + "DEF", "abc" + "." * 60 + "def"),
    ]


def test_offsets_and_context(spark):
    text = "é%41 _ " * 30 + "Jane_Doe" + " ~%42é" * 30
    row = places(spark, [("s", 0, text)], [("s", "Jane Doe", "PERSON", False)], kinds=("full",)).first()
    at = text.index("Jane_Doe")
    assert (row.start_at, row.end_at, row.before, row.after) == (at, at + 8, text[at - 42 : at], text[at + 8 : at + 50])


def test_first_word_that_is_most_of_a_long_text(spark):
    """Many values begin alike, one long text is full of that word."""
    known = [("s", f"Jane Doe{chr(97 + i // 26)}{chr(97 + i % 26)}", "PERSON", False) for i in range(500)]
    text = "Jane_Doeab Jane " * 10_000
    got = places(spark, [("s", 0, text)], known, kinds=("full",)).agg(F.count(F.lit(1)).alias("n"), F.max("end_at").alias("e"), F.countDistinct("value").alias("v")).first()
    assert (got.n, got.e, got.v) == (10_000, len(text) - 6, 1)


def test_empty_tables(spark):
    assert places(spark, [], [("s", "Jane Doe", "PERSON", False)]).count() == 0
    assert places(spark, [("s", 0, "Jane_Doe")], []).count() == 0
