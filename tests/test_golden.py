"""Stated behaviours, all run through the same jobs in one pass."""

import pytest

from veil import Config
from veil.lexicons import COMMON_FIRST_NAMES, Lexicons
from veil.operators.detect import detect, text_rules
from veil.operators.encoded import detect_encoded, drop_in_base64
from veil.operators.resolve import select_findings
from veil.operators.score import score
from veil.operators.tabular import detect_tables

BLOB = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9w" + "1HGCM82633A004352" + "QUJDREVG"

# text -> expected (type, value, via, points) in order; points may be None
CASES = {
    "x marcus.delacroix@example.com. Referred by": [("EMAIL", "marcus.delacroix@example.com", "structural", 90)],
    "Kandidat (9008130035084)": [("SA_ID", "9008130035084", "sa_id_weak", 72)],
    "ID 9008130035084": [("SA_ID", "9008130035084", "sa_id_weak", 87)],
    "3505 4121 6080 5306": [("CREDIT_CARD", "3505 4121 6080 5306", "checksum", 95)],
    "2018 2016 1999": [],
    "2020 2021 2022": [],
    "07700 900123": [("PHONE", "07700 900123", "shape", 55)],
    "order 0821234567": [],
    "call 0821234567 about the order": [("PHONE", "0821234567", "shape", 70)],
    '"tax_number": "0123456789"': [("ID", "0123456789", "field", 99)],
    "DE89 3704 0044 0532 0130 00": [("IBAN", "DE89 3704 0044 0532 0130 00", "checksum", 95)],
    "DE89 3704 0044 0532 0130 01": [("IBAN", "DE89 3704 0044 0532 0130 01", "shape", 55)],
    "2001:db8:85a3::8a2e:370:7334": [("IPV6", "2001:db8:85a3::8a2e:370:7334", "structural", 90)],
    "10:30:45": [],
    "the name behind it": [],
    "cardholder: jane doe": [("PERSON", "jane doe", "label", 58)],
    "company_name: Acme Logistics": [],
    "company-name: Acme Logistics": [("PERSON", "Acme Logistics", "label", 78)],
    "Port Louis": [],
    "PRIYA RAMESH": [("PERSON", "PRIYA RAMESH", "gazetteer", 80)],
    "Jane Doe Please": [("PERSON", "Jane Doe", "gazetteer", 80)],
    "J.R.R. Tolkien": [("PERSON", "J.R.R. Tolkien", "gazetteer", 80)],
    "Mr Zzyzx Qwerty": [("PERSON", "Zzyzx Qwerty", "honorific", 77)],
    "born on 3 Widget 2020": [],
    "born 99/99/9999": [],
    "| Date of birth | 1951-06-21 |\n| note | x |": [("DOB", "1951-06-21", "field", None)],
    "id,date_of_birth,note\n1,1990-01-02,note": [("DOB", "1990-01-02", "field", None)],
    "P.O. Box 5512, Sandton, 2196": [("STREET_ADDRESS", "P.O. Box 5512, Sandton, 2196", "shape", 55)],
    "12 Kloof Street, Cape Town, 7700": [("STREET_ADDRESS", "12 Kloof Street, Cape Town, 7700", "shape", 55)],
    "the role is based in Cape Town": [],
    "phone=%2B27825550143": [("PHONE", "+27825550143", "structural", None)],
    "name [at] example [dot] com": [("EMAIL", "name@example.com", "structural", 90)],
    "see [PERSON_1] there": [("LITERAL", "[PERSON_1]", "token_literal", 99)],
    BLOB: [],
    "server listening on 0.0.0.0:8080": [("IPV4", "0.0.0.0", "shape", 55)],
    "é42 12 x": [],
    "token = '24be64439e3e49cf46b2d7c90f3602a3'": [("SECRET", "24be64439e3e49cf46b2d7c90f3602a3", "secret", 99)],
    "postgres://u:pw@h/db": [("CONNECTION_STRING", "postgres://u:pw@h/db", "secret", 97)],
    "1HGCM82633A004352": [("VIN", "1HGCM82633A004352", "shape", 55)],
}


@pytest.fixture(scope="module")
def results(spark):
    texts = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    config = Config(detectors={"PERSON": True}, lexicons=Lexicons(first_names=(*COMMON_FIRST_NAMES, "jane", "priya")))
    keys = ["doc_id"]
    raw = detect(texts, text_rules(config, spark), keys, config)
    raw = raw.unionByName(detect_encoded(texts, keys, config, spark)).unionByName(detect_tables(texts, keys))
    kept = select_findings(score(drop_in_base64(raw, texts, keys)), keys, config)
    rows = {}
    for r in sorted(kept.collect(), key=lambda r: (r.doc_id, r.start_at)):
        rows.setdefault(r.doc_id, []).append(r)
    return rows


@pytest.mark.parametrize("no,text", list(enumerate(CASES)))
def test_golden(results, no, text):
    got = results.get(no, [])
    want = CASES[text]
    assert [(r.type, r.value, r.via) for r in got] == [w[:3] for w in want]
    assert all(w[3] is None or r.points == w[3] for r, w in zip(got, want))
    for r in got:
        assert text[r.start_at : r.end_at] == r.surface


def test_strict_mode_needs_a_known_name(spark):
    texts = spark.createDataFrame([(0, "Mr Zzyzx Qwerty"), (1, "Dr Sarah Johnson")], "doc_id bigint, text string")
    config = Config.only("PERSON", person_mode="strict")
    found = detect(texts, text_rules(config, spark), ["doc_id"], config).collect()
    assert [(r.doc_id, r.value) for r in found] == [(1, "Sarah Johnson")]


def test_offsets_count_characters(spark):
    text = "😀 é jane@acme.com ☂ bob@acme.com"
    texts = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    found = detect(texts, text_rules(Config.only("EMAIL")), ["doc_id"]).collect()
    assert sorted(text[r.start_at : r.end_at] for r in found) == ["bob@acme.com", "jane@acme.com"]


def test_many_matches_in_one_text(spark):
    text = " ; ".join(f"u{i}@acme.com" for i in range(3000))
    texts = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    found = detect(texts, text_rules(Config.only("EMAIL")), ["doc_id"]).collect()
    assert len(found) == 3000 and all(text[r.start_at : r.end_at] == r.value for r in found)
