"""Every first name of a session goes with every last name, and only pairs that stand in a text are made."""

from veil import Config
from veil.operators.known import sweep, variants

KNOWN = "session_id string, value string, type string, sure boolean"
FOUND = "session_id string, doc_id int, start_at int, end_at int"
TEXTS = "session_id string, doc_id int, text string"
KEYS = ["session_id", "doc_id"]
FIRST = ["James", "Mary", "Robert", "Jennifer", "David", "Susan"]
# more single names than the eight that were tried before
LAST = [f"{a}{b}field" for a in ("Ash", "Brom", "Mans", "Whit") for b in ("", "en", "er", "le")] + ["O'Brien", "Roe", "Zed12"]


def test_all_pairs_and_no_product(spark):
    known = spark.createDataFrame([("s", n, "PERSON", False) for n in FIRST + LAST] + [("t", "Susan", "PERSON", False), (None, "Mary", "PERSON", False)], KNOWN)
    texts = [
        ("s", 0, "susan_whitlefield, mary-ashfield9 and /cv/JenniferMansenfield.pdf or www.x.org/swhitfield; mary whitfield, roe_susan, s_roe"),
        ("s", 1, "james%20ashenfield jameszed12 james_zed1234 mary zed99 mary_mary"), ("t", 2, "susan_whitfield susan_susan"), (None, 3, "mary_roe"), ("s", 4, None),
    ]
    corpus = spark.createDataFrame(texts, TEXTS)
    got = sweep(corpus, spark.createDataFrame([], FOUND), known, KEYS, Config(), kinds=("pair",)).collect()
    assert {(r.doc_id, r.surface, r.value) for r in got if texts[r.doc_id][2][r.start_at : r.end_at] == r.surface} == {
        (0, "susan_whitlefield", "Whitlefield"), (0, "mary-ashfield9", "Ashfield"), (0, "JenniferMansenfield", "Mansenfield"), (0, "swhitfield", "Whitfield"),
        (0, "mary whitfield", "Whitfield"), (1, "james%20ashenfield", "Ashenfield"), (1, "jameszed12", "Zed12"), (1, "james_zed1234", "Zed12"),
    }
    assert len(got) == 8
    made = variants(known, "session_id", Config(), ("pair",), corpus).select("value", "firsts").distinct().count()
    assert made < 15  # of 6 * 24 pairs, as many with initials
