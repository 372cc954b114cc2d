"""Words that only begin like a known value aren't followed, and cheap tests pass over no text that a rule would match."""

from dataclasses import replace

from veil import Config
from veil.operators.detect import detect, text_rules
from veil.operators.encoded import BASE64_RUN_RULE, REGION_RULES
from veil.operators.known import first_words, sweep, variants, word_runs

KNOWN = "session_id string, value string, type string, sure boolean"
FOUND = "session_id string, doc_id int, start_at int, end_at int"
TEXTS = "session_id string, doc_id int, text string"
KEYS = ["session_id", "doc_id"]


def test_only_words_that_go_on_like_a_value(spark):
    known = spark.createDataFrame([("s", "the.41@mail2.org", "EMAIL", True)], KNOWN)
    corpus = spark.createDataFrame([("s", 0, "the ab, the cd; the of the 42 " * 50 + "see THE_41 now"), ("s", 1, "the 4"), ("s", 2, None)], TEXTS)
    forms = variants(known, "session_id", Config())
    runs = word_runs(corpus, first_words(forms, "session_id"), KEYS).select("doc_id", "key").distinct().collect()
    assert {(r.doc_id, r.key) for r in runs if len(r.key) == 5 and not r.key.endswith("#")} == {(0, "the42"), (0, "the41")}  # "theab" and "thecd" as well before
    got = sweep(corpus, spark.createDataFrame([], FOUND), known, KEYS, Config()).collect()
    assert [(r.doc_id, r.surface, r.value) for r in got] == [(0, "THE_41", "the.41@mail2.org")]


def test_digits_and_joined_words(spark):
    known = [("s", "Zoë Ann Müller", "PERSON", False), ("s", "AB 12", "ID", True), ("s", "Doe41", "PERSON", True)]
    texts = [("s", 0, "Zoë_Ann_Müller9 ZOË_ANN x/zoëann-müller/ zoëannmüller.pdf"), ("s", 1, "ab12 ab 12 AB 13 ab 123 AB"), ("s", 2, "doe4199 doe 41 DOE41 doe42")]
    corpus = spark.createDataFrame(texts, TEXTS)
    got = sweep(corpus, spark.createDataFrame([], FOUND), spark.createDataFrame(known, KNOWN), KEYS, Config()).collect()
    assert sorted((r.doc_id, r.start_at, r.surface) for r in got) == [
        (0, 0, "Zoë_Ann"), (0, 0, "Zoë_Ann_Müller9"), (1, 0, "ab12"), (1, 5, "ab 12"), (1, 17, "ab 123"), (2, 8, "doe"), (2, 15, "DOE41"),
    ]


ODD = [
    "", "mail a@b.co", "card 4111 1111 1111 1111", "id 8001015009087", "ssn 123-45-6789", "call +27 82 123 4567", "10.0.0.1", "IBAN GB82 WEST 1234 5698 7654 32",
    "FE80::ab", "aa:bb:cc:dd:ee:ff", "1HGCM82633A004352", "ABCDE1234F", "AB123456C", "2345 6789 0124", "0x" + "aB3" * 13 + "f", "1" + "aB3" * 9, "bc1" + "q" * 30,
    "P.O. BOX 12", "PRIVATE BAG X9", "-26.2041, 28.0473", "12 Main Street", "[EMAIL_1]", "PATIENT: Jane Doe", "\"Candidate\": \"Jane Doe\"", "née Müller", "nee Smith",
    "Date of Birth 1990-01-02", "D. O. B. 2 Jan 1990", "dob: 1990-01-02", "passport = A1234567", "Tax no 12345", "AKIA" + "A1" * 8, "xoxb-1234567890", "password: hunter22",
    "password=hunter22", "https://u:p@h", "jane%40doe.org", "jane&#64;doe.org", "jane [AT] doe [DOT] org", "Q" * 24, "x " + "Q" * 70, "-" + "q/+" * 24 + "=", "n\nBORN Smith",
]


def test_cheap_tests_pass_over_nothing(spark):
    corpus = spark.createDataFrame([("s", i, t) for i, t in enumerate(ODD)], TEXTS)
    for rules in (text_rules(Config(), spark), [*REGION_RULES, BASE64_RUN_RULE]):
        bare = [replace(r, guard=None, digit=False) for r in rules]
        run = lambda rs: sorted(map(tuple, detect(corpus, rs, KEYS).collect()))  # noqa: B023, E731
        assert run(rules) == run(bare) != []
