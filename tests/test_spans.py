"""Matches, offsets and contexts against Python's own regexes, and what a pass over a text costs."""

import random
import re

from veil.functions.text import ALT, CLOSE, OPEN
from veil.operators import rules as R
from veil.operators.spans import EITHER, Rule, find_spans

KEYS = ("SSN", "IPV4", "MAC", "VIN", "PAN_INDIA", "ETH_ADDRESS", "STREET_ADDRESS")
PIECES = [
    "123-45-6789", "10.2.3.255", "1.2.3.400", "00:1A:2b:9f-3c:4D", "1HGCM826X00000017", "1hgcm826x0000001", "ABCDE1234F", "0x" + "aB" * 20, "7", "x", "_",
    " ", " ", "\n", ". ", "-", ":", "é", "ſ", "K", "😀", OPEN, CLOSE, ALT, "12 Long Hill Road, Cape Town, 8001", "9 Kloof Map", "word " * 9,
]


def _rules():
    return [r for r in R.BUILTIN if r.key in KEYS]


def _expected(doc_id, text):
    text = re.sub(f"[{OPEN}{CLOSE}{ALT}]", "�", text)
    for i, rule in enumerate(_rules()):
        border = rule.pattern.replace(r"\<", r"(?<![A-Za-z0-9_])").replace(r"\>", r"(?![A-Za-z0-9_])")
        for m in re.finditer(border, text, re.A | (re.I if "i" in rule.flags else 0)):
            a, b = m.span()
            yield doc_id, i, a, b, m.group(), text[max(a - 42, 0) : a], text[b : b + 42]


def test_matches_as_python_finds_them(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice((3, 12, 60))))) for i in range(300)] + [(300, ""), (301, None)]
    found = find_spans(spark.createDataFrame(texts, "doc_id bigint, text string"), _rules(), ["doc_id"])
    got = sorted(tuple(r) for r in found.select("doc_id", "rule", "start_at", "end_at", "value", "before", "after").collect())
    assert got == sorted(x for i, t in texts if t for x in _expected(i, t))
    assert len({r[1] for r in got}) == len(KEYS)


def test_marks_of_two_kinds(spark):
    rule = Rule("X", r"(id:)([0-9]+)|(id )([0-9]+)", mark=EITHER, raw=True)
    texts = spark.createDataFrame([(1, "id:12"), (2, "😀 id 7, id:8; id 99")], "doc_id int, text string")
    rows = find_spans(texts, [rule], ["doc_id"], context=3).orderBy("doc_id", "start_at").collect()
    assert [(r.doc_id, r.start_at, r.value, r.explicit, r.before, r.after) for r in rows] == [
        (1, 3, "12", True, "id:", ""), (2, 5, "7", False, "id ", ", i"), (2, 11, "8", True, "id:", "; i"), (2, 17, "99", False, "id ", ""),
    ]


def test_texts_are_cut_without_a_second_regex(spark):
    """One regex a rule: texts are split at a single character, and blanked only where they hold a marker."""
    texts = spark.range(5).selectExpr("id AS doc_id", "concat('no ', id) AS text")
    plan = find_spans(texts, _rules(), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert f"[{OPEN}{CLOSE}]" not in plan
    assert "[A-Za-z0-9]{17}" not in plan and "THEN translate(" in plan
