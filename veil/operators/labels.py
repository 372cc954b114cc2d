"""Values announced by a label in front of them: names, identifiers, dates of birth."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions.text import SPACES, java, let, trim
from veil.lexicons import Lexicons
from veil.operators.rules import both, has, names, names_any_case
from veil.operators.spans import EITHER, LABELLED, Rule

# Label vocabularies and value shapes. Group 1 is the label, group 2 the value.
NAME_LABELS = r"full name|first name|last name|sur\s?name|name|patient|beneficiary|cardholder|account holder"
NAME_VALUE = r"\p{L}[\p{L}\p{M}'’\-]+(?:[ ]+\p{L}[\p{L}\p{M}'’\-]+){0,2}"
NAME_WORDS = r"full|first|given|last|sur|family|middle|preferred|maiden"
FIELD_NAME_VALUE = r"\p{L}[\p{L}\p{M}'’\-]+(?:[ \t]+\p{L}[\p{L}\p{M}'’\-]+){0,2}"
ID_LABELS = (
    r"medical aid|health plan|scheme|policy|membership|account|acc|passport|licen[cs]e|employee|staff|customer|tax"
    r"|vat|national id|id|patient"
)
ID_WORDS = (
    r"passport|national[_\-\s]?id|identity[_\-\s]?(?:number|no)|id[_\-\s]?(?:number|no)\>|tax|vat|ssn"
    r"|social[_\-\s]?security|nino|drivers?[_\-\s]?licen[cs]e|licence|license|medical[_\-\s]?aid"
)
DATES = (
    r"(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})|(?:\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9},?\s+\d{4})"
    r"|(?:[A-Za-z]{3,9}\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})"
)
DOB_LABELS = r"date of birth|d\.?\s?o\.?\s?b\.?|birth\s?date|date born|born(?:\s+on)?"
DOB_KEYS = r"date[_\-\s]?of[_\-\s]?birth|birth[_\-\s]?date|birthday|dob"
MAIDEN_LABELS = r"n[ée]e|born|formerly|previously|maiden name"
MONTHS = (
    "jan feb mar apr may jun jul aug sep oct nov dec january february march april june july august september "
    "october november december"
).split()

LABEL_NAME = rf"(\<(?:{NAME_LABELS})\s*[:=]\s*)({NAME_VALUE})|(\<(?:{NAME_LABELS})[ \t]+)({NAME_VALUE})"
FIELD_NAME = (
    rf"((?<![A-Za-z][_\-])\<(?:(?:{NAME_WORDS})[_\-\s]?names?|names?|candidate|applicant)"
    rf'(?:"?\s*[:=]\s*"?|>\s*))({FIELD_NAME_VALUE})'
)
MAIDEN = rf"(\<(?:{MAIDEN_LABELS})\s+)(\p{{Lu}}[\p{{L}}\p{{M}}'’\-]{{1,30}})"
LABEL_ID = rf"(\<(?:{ID_LABELS})\s*(?:numbers?|no\.?|nr|#|id)?\s*[:=#]?\s+)([A-Za-z0-9][A-Za-z0-9\-/]{{3,}})"
FIELD_ID = (
    rf"((?<![A-Za-z0-9][_\-])\<(?:{ID_WORDS})[_\-\s]?(?:number|no|nr|ref|reference)?"
    rf'"?\s*[:=]\s*"?)([A-Za-z0-9][A-Za-z0-9\-/]{{4,}})'
)
LABEL_DOB = rf"(\<(?:{DOB_LABELS})\s*[:=]?[ \t]*[.…_]{{0,60}}[ \t]*)({DATES})"
FIELD_DOB = rf'((?<![A-Za-z][_\-])\<(?:{DOB_KEYS})(?:"?\s*[:=]\s*"?|>\s*))({DATES})'

# Object keys that declare what sits beneath them.
KEY_NAME = (
    rf"(?i)^(?:(?:{NAME_WORDS})[_\- ]?)?names?$"
    r"|^(?:candidate|applicant|patient|beneficiary|cardholder|account[_\- ]?holder)(?:[_\- ]?name)?$"
)
KEY_DOB = r"(?i)^(?:date[_\- ]?of[_\- ]?birth|birth[_\- ]?date|birthday|dob)$"
KEY_ID = (
    r"(?i)^(?:passport(?:[_\- ]?(?:no|number))?|national[_\- ]?id(?:[_\- ]?number)?|id[_\- ]?number"
    r"|identity[_\- ]?number|tax(?:[_\- ]?(?:no|number|ref|reference))?|ssn|social[_\- ]?security(?:[_\- ]?number)?"
    r"|nino|ni[_\- ]?number|driver'?s?[_\- ]?licen[cs]e(?:[_\- ]?number)?|medical[_\- ]?aid(?:[_\- ]?number)?)$"
)


def word_norm(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"[.'’\-]+$", "")


def first_words(text: Column, n: Column) -> Column:
    """The exact beginning of ``text`` up to its n-th word, for n of 1 to 3."""
    one, gap = java(r"\S+"), java(r"\s+")
    pick = lambda k: F.regexp_extract(text, one + f"(?:{gap}{one})" * (k - 1), 0)
    return F.when(n == 1, pick(1)).when(n == 2, pick(2)).otherwise(pick(3))


def kept_words(words: Column, droppable) -> Column:
    """How many leading words remain when droppable ones are cut from the end; at least one."""
    return F.array_max(F.transform(words, lambda w, i: F.when((i > 0) & droppable(w), F.lit(1)).otherwise(i + 1)))


def valid_name(cap: Column, explicit: Column, lex: Lexicons) -> Column:
    """The part of a captured value that reads as a name, or NULL."""
    stop, known = list(lex.stopwords), list(lex.first_names)

    def judge(words):
        keep = kept_words(words, lambda w: word_norm(w).isin(stop) & ~word_norm(w).isin(known))
        kept = F.slice(words, 1, keep)
        title = F.forall(kept, lambda w: w.rlike("^[A-Z]"))
        named = F.exists(kept, lambda w: word_norm(w).isin(known))
        ok = ~word_norm(F.get(words, F.lit(0))).isin(stop) & (explicit | title | named)
        return F.when(ok, first_words(cap, keep))

    return let(F.filter(F.split(cap, java(r"\s+")), lambda w: w != ""), judge)


def valid_date(v: Column) -> Column:
    """A plausible calendar date: a year of 1800 to 2099, no impossible number, a real month word."""
    numbers = F.regexp_extract_all(F.regexp_replace(v, java(r"(?:st|nd|rd|th)\>", "i"), ""), F.lit(r"\d{1,4}"), F.lit(0))
    word = F.lower(F.regexp_extract(v, "[A-Za-z]{3,9}", 0))
    year = v.rlike(java(r"\<(?:1[89]\d\d|20\d\d)\>"))
    return year & ~F.exists(numbers, lambda n: n.cast("int").between(32, 999)) & ((word == "") | word.isin(MONTHS))


has_digit = has("[0-9]")


def label_rules() -> list[Rule]:
    born = lambda text: names_any_case("birth", "born")(text) | has(java(r"d\.?\s?o\.?\s?b", "i"))(text)
    return [
        Rule("PERSON", LABEL_NAME, "iu", "label", "LABEL_NAME", EITHER,
             guard=names_any_case("name", "patient", "beneficiary", "cardholder", "account holder")),
        Rule("PERSON", FIELD_NAME, "iu", "field", "FIELD_NAME", LABELLED, guard=both(names_any_case("name", "candidate", "applicant"), has("(?is)(?:name|candidate|applicant).*?[:=>]"))),
        Rule("PERSON", MAIDEN, "", "label", "MAIDEN", LABELLED, guard=names("née", "nee", "born", "formerly", "previously", "maiden name")),
        Rule("ID", FIELD_ID, "i", "field", "FIELD_ID", LABELLED, guard=names(":", "="), valid=has_digit, digit=True),
        Rule("DOB", FIELD_DOB, "i", "checksum", "FIELD_DOB", LABELLED, guard=born, valid=valid_date, digit=True),
        Rule("ID", LABEL_ID, "i", "label", "LABEL_ID", LABELLED, valid=has_digit, digit=True),
        Rule("DOB", LABEL_DOB, "i", "checksum", "LABEL_DOB", LABELLED, guard=born, valid=valid_date, digit=True),
    ]


LABEL_RULE_NAMES = tuple(r.key for r in label_rules())


def name_value(rule_key: Column, value: Column, explicit: Column, lex: Lexicons) -> Column:
    """Value of a label match after the name check; other rules keep what they captured."""
    named = partial(valid_name, value, lex=lex)
    return (
        F.when(rule_key == "LABEL_NAME", named(explicit))
        .when(rule_key == "FIELD_NAME", named(F.lit(True)))
        .otherwise(value)
    )


def key_label(key: Column) -> Column:
    """The prose label an object key stands for, or NULL."""
    return (
        F.when(key.rlike(KEY_NAME), "full name").when(key.rlike(KEY_DOB), "date of birth").when(key.rlike(KEY_ID), "national id")
    )


# What a table header says about the cells it heads.
COLUMN_TYPES = [
    (r"(?i)^(?:full[_\- ]?name|first[_\- ]?name|last[_\- ]?name|sur[_\- ]?name|given[_\- ]?name|name|candidate|applicant"
     r"|patient|employee[_\- ]?name|customer[_\- ]?name|student[_\- ]?name)$", "PERSON"),
    (r"(?i)^(?:date[_\- ]?of[_\- ]?birth|birth[_\- ]?date|birthday|dob)$", "DOB"),
    (r"(?i)^(?:e[_\- ]?mail|email[_\- ]?address|email)$", "EMAIL"),
    (r"(?i)^(?:phone|telephone|mobile|cell|contact[_\- ]?number|msisdn)$", "PHONE"),
    (r"(?i)^(?:address|street[_\- ]?address|residential[_\- ]?address|home[_\- ]?address)$", "STREET_ADDRESS"),
]


_HEADINGS = "|".join(p.removeprefix("(?i)^").removesuffix("$") for p, _ in COLUMN_TYPES)
# a text can only hold a header or a labelled cell if one of the words fills a whole cell of some kind; each heading has one of the second list
HAS_HEADING = rf"(?im)(?:^|[\t|,>])[{SPACES}*]*(?:{_HEADINGS})[{SPACES}*]*(?:$|[\t|,<\r])"
HEADING_WORDS = "name candidate applicant patient birth dob mail phone mobile cell contact msisdn address".split()
_MAY_HEAD = rf"(?i)^[{SPACES}*]*(?:{_HEADINGS})[{SPACES}*]*$"


def column_type(header: Column) -> Column:
    """Type of the values under a header, or NULL."""

    def kind(bare):
        chain = F
        for pattern, type_ in COLUMN_TYPES:
            chain = chain.when(bare.rlike(pattern), F.lit(type_))
        return chain

    # most cells are no headers at all and need a single look
    return F.when(header.rlike(_MAY_HEAD), let(F.regexp_replace(trim(header), r"^\**|\**$", ""), kind))
