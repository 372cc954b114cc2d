"""The rules of the value detectors and how a configuration selects them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.text import digits, java, let, luhn, mod97, trim, verhoeff
from veil.operators.spans import Rule

# Java keeps a frame for each turn of a greedy group, so a long text could overflow the stack. Groups that repeat without a
# bound are therefore possessive, with a look-ahead where the pattern has to stop before the last turn.

# The formats looked for. \< and \> stand for the borders of an ASCII word.
_LABEL = r"(?:\.[\p{L}0-9\-]++|[ ]\.[ ]?[\p{Ll}0-9\-]++|\.[ ][\p{Ll}0-9\-]++)(?:[ ][\p{Ll}0-9\-]++)?"
_TOP = r"(?:\.[\p{L}]{2,}|[ ]\.[ ]?[\p{Ll}]{2,}|\.[ ][\p{Ll}]{2,})"
_NOT_TOP = rf"(?:(?!{_TOP}){_LABEL})*+"  # labels that no address can end with
EMAIL = (
    r"(?:\G|(?<![\p{L}0-9._%+\-]))[\p{L}0-9._%+\-]+[ ]?@[ ]?[\p{L}0-9\-]++(?:[ ][\p{Ll}0-9\-]++)?"
    rf"(?:{_NOT_TOP}(?={_TOP}){_LABEL}(?={_NOT_TOP}{_TOP}))*+{_NOT_TOP}{_TOP}"
)
CREDIT_CARD = r"(?<![\d])\d(?:[ \-]?\d){12,18}(?![\d])"
SA_ID = r"(?<!\w)\d{6}[ \x{a0}.\-/]?\d{4}[ \x{a0}.\-/]?\d{2}[ \x{a0}.\-/]?\d(?!\w)"
SSN = r"\<\d{3}-\d{2}-\d{4}\>"
PHONE = (
    r"(?<!\w)(?:\+\d{1,3}[ \x{a0}\-.]?)?(?:\(\d{1,4}\)[ \x{a0}\-.]?|\d{1,4}[ \x{a0}\-.])?"
    r"\d{2,6}(?:[ \x{a0}\-.]\d{2,6}){1,4}(?!\w)"
    r"|(?<![\w.])\+\d{1,3}(?:[ \x{a0}\-.]?\d{1,9}){1,4}(?!\w)"
    r"|(?<![\w.])\+\d{9,14}(?!\w)|(?<![\w.])\d{9,11}(?!\w)"
)
IPV4 = r"\<(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\>"
IBAN = (
    r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?(?![A-Z0-9])"
    r"|(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
)
# the compressed form has to be tried first, or its prefix would match and fail
IPV6 = (
    r"\<(?:[A-F0-9]{1,4}:){1,7}:(?:[A-F0-9]{1,4}:?){0,6}[A-F0-9]{0,4}\b"
    r"|\<(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4}\>"
)
MAC = r"\<(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}\>"
VIN = r"\<[A-HJ-NPR-Z0-9]{17}\>"
PAN_INDIA = r"\<[A-Z]{5}[0-9]{4}[A-Z]\>"
NINO_UK = r"\<[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\>"
AADHAAR = r"(?<![\d][ \-.])\<[2-9]\d{3} \d{4} \d{4}\>(?![ \-.]?\d)"
ETH_ADDRESS = r"\<0x[a-fA-F0-9]{40}\>"
BTC_ADDRESS = r"\<(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\>"
PO_BOX = (
    r"\<(?:P\.?\s?O\.?\s?Box|Post(?:al)? Box|Private Bag(?: X)?)\s*[:#]?\s*[A-Za-z0-9\-]{1,10}"
    r"(?:,? +(?:\p{Lu}[\p{L}'.\-]+)(?: +\p{Lu}[\p{L}'.\-]+){0,2})?(?:,? +\d{4,5})?"
)
GPS = r"(?<![\d.])-?(?:[0-8]?\d|90)\.\d{3,8}\s*,\s*-?(?:1[0-7]\d|[0-9]?\d)\.\d{3,8}(?![\d.])"
STREET_ADDRESS = (
    r"\<\d{1,6}[A-Za-z]?\s+(?:[A-Z][A-Za-z'.\-]+\s+){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln"
    r"|Drive|Dr|Court|Ct|Place|Pl|Way|Terrace|Ter|Close|Crescent|Cres|Square|Sq|Parkway|Pkwy|Highway|Hwy|Trail"
    r"|Circle|Cir|Loop|Row|Walk)\>\.?(?:,? +(?:[A-Z][A-Za-z'.\-]+)(?: +[A-Z][A-Za-z'.\-]+){0,2})?"
    r"(?:,? +(?:[A-Z]{1,2}\d[A-Z\d]? *\d[A-Z]{2}|\d{4,5}(?:-\d{4})?))?"
)
DATE_SHAPES = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
NINO_BARRED = r"^(?:BG|GB|NK|KN|TN|NT|ZZ)"

# Credential formats as their issuers document them (own patterns).
API_KEY = (
    r"\<(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])"
)
_KEY_WORDS = r"(?:(?!PRIVATE KEY-)[A-Z]+ )*+"
PRIVATE_KEY = rf"-----BEGIN {_KEY_WORDS}PRIVATE KEY-----[\s\S]*?-----END {_KEY_WORDS}PRIVATE KEY-----"
JWT = r"\<eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_-])"
CONNECTION_STRING = r"\<[a-z][a-z0-9+]++://[^\s:/@\"'<>]+:[^\s/@\"'<>]+@[^\s\"'<>&]+"
SECRET_LABELS = r"passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?token"
LABELLED_SECRET = (
    rf"((?<![A-Za-z0-9])(?:{SECRET_LABELS})(?:\"|'|&quot;)?\s*[:=]\s*(?:\"|'|&quot;)?)"
    r"([A-Za-z0-9+/_.~!@#$%^*=-]{8,})"
)

SECRET_TYPES = ("API_KEY", "PRIVATE_KEY", "SEED_PHRASE", "JWT", "CONNECTION_STRING", "SECRET")


def has(pattern: str):
    return lambda text: text.rlike(pattern)


def names(*words: str):
    """Whether one of the words stands in a text: plain search, many times cheaper than alternatives of a pattern."""
    return lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def names_any_case(*words: str):
    """As ``names``, for words in small letters, whatever the case in the text."""
    return lambda text: let(F.lower(text), names(*words))


def both(cheap: Callable[[Column], Column], exact: Callable[[Column], Column]):
    """``exact``, tried only where ``cheap`` holds, which it does wherever ``exact`` does."""
    return lambda text: cheap(text) & exact(text)


def has_run(n: int):
    """Whether so many word characters, ``+`` and ``/`` follow each other, looked for only where such a run begins."""
    return lambda text: text.rlike(rf"[^\w+/][\w+/]{{{n}}}") | F.left(text, F.lit(n)).rlike(rf"^[\w+/]{{{n}}}")


def _sa_id_valid(v: Column) -> Column:
    d = digits(v)
    month, day = F.substring(d, 3, 2), F.substring(d, 5, 2)
    return month.between("01", "12") & day.between("01", "31") & F.substring(d, 11, 1).isin("0", "1")


def _phone_valid(v: Column) -> Column:
    t, d = trim(v), digits(v)
    groups = F.split(t, r"[ \-.]+")
    all_fours = (F.size(groups) > 1) & F.forall(groups, lambda g: F.length(g) == 4)
    signal = t.rlike(r"^\+") | t.rlike("[()]") | d.startswith("0") | t.rlike(r"[ \-.]") | (F.length(d) >= 10)
    return F.length(d).between(7, 15) & ~t.rlike(DATE_SHAPES) & ~all_fours & signal


def _iban_bare(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, java(r"[\s\-]"), ""))


def _ipv6_valid(v: Column) -> Column:
    colons = F.length(v) - F.length(F.replace(v, F.lit(":"), F.lit("")))
    clock = (colons <= 2) & v.rlike(r"^\d{1,2}(?::\d{1,2}){1,2}$")
    return ~clock & (F.contains(v, F.lit("::")) | (colons >= 4))


def _vin_valid(v: Column) -> Column:
    return v.rlike("(?i)[A-HJ-NPR-Z]") & v.rlike("[0-9]")


def _aadhaar_valid(v: Column) -> Column:
    years = F.forall(F.split(v, " "), lambda g: g.between("1900", "2099"))
    return ~years & verhoeff(digits(v))


def _jwt_valid(v: Column) -> Column:
    header = F.translate(F.substring_index(v, ".", 1), "-_", "+/")
    padded = F.rpad(header, (F.ceil(F.length(header) / 4) * 4).cast("int"), "=")
    json = F.make_valid_utf8(F.call_function("try_to_binary", padded, F.lit("base64")).cast("string"))
    return F.get_json_object(json, "$").isNotNull()


def _card_valid(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(13, 19) & luhn(d)


BUILTIN = [
    Rule("EMAIL", EMAIL, via="structural", guard=lambda t: F.contains(t, F.lit("@"))),
    Rule("CREDIT_CARD", CREDIT_CARD, via="checksum", guard=has("[0-9][ 0-9-]{11}[0-9]"), valid=_card_valid, digit=True),
    Rule(
        "SA_ID", SA_ID, guard=has(r"[0-9]{6}.?[0-9]{4}"), valid=_sa_id_valid,
        grade=lambda v: F.when(luhn(digits(v)), "checksum").otherwise("sa_id_weak"), digit=True,
    ),
    Rule("SSN", SSN, first="[0-9]", digit=True),
    Rule("PHONE", PHONE, guard=has(r"[0-9]{2}"), valid=_phone_valid, digit=True),
    Rule("IPV4", IPV4, first=r"[0-9]{1,3}\.", digit=True),
    Rule(
        "IBAN", IBAN, guard=has("[A-Z]{2}[0-9]{2}"), valid=lambda v: F.length(_iban_bare(v)).between(15, 34),
        grade=lambda v: F.when(mod97(_iban_bare(v)) == 1, "checksum").otherwise("shape"), digit=True,
    ),
    Rule("IPV6", IPV6, "i", "structural", guard=both(names(":"), has("[A-Fa-f0-9]:[A-Fa-f0-9:]")), valid=_ipv6_valid),
    Rule("MAC", MAC, "i", "structural", guard=has("[:-][0-9A-Fa-f]{2}[:-]"), first="[0-9A-F]{2}[:-]"),
    Rule("VIN", r"\<(?=\w{17}\>)" + VIN, "i", valid=_vin_valid, digit=True),
    Rule("PAN_INDIA", PAN_INDIA, via="structural", first="[A-Z]{5}", digit=True),
    Rule("NINO_UK", NINO_UK, via="checksum", guard=has("[A-Z]{2} ?[0-9]{2}"),
         valid=lambda v: ~F.replace(v, F.lit(" "), F.lit("")).rlike(NINO_BARRED), digit=True),
    Rule("AADHAAR", AADHAAR, via="checksum", guard=has("[0-9]{4} [0-9]{4} [0-9]{4}"), valid=_aadhaar_valid, digit=True),
    Rule("ETH_ADDRESS", ETH_ADDRESS, via="structural", guard=lambda t: F.contains(t, F.lit("0x")), first="0x"),
    Rule("BTC_ADDRESS", BTC_ADDRESS, via="structural", guard=has("[b13][a-zA-Z0-9]{25}"), digit=True),
    Rule("STREET_ADDRESS", PO_BOX, "iu", name="PO_BOX", guard=names_any_case("box", "private bag")),
    Rule("GPS", GPS, guard=has(r"[0-9]\.[0-9]{3}"), digit=True),
    Rule("STREET_ADDRESS", STREET_ADDRESS, first="[0-9]", digit=True),
]

SECRETS = [
    Rule("API_KEY", API_KEY, via="secret", guard=both(names("AKIA", "ASIA", "AIza", "xox", "_"), has("AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k_(?:live|test)_|AIza"))),
    Rule("PRIVATE_KEY", PRIVATE_KEY, via="secret", guard=lambda t: F.contains(t, F.lit("PRIVATE KEY"))),
    Rule("JWT", JWT, via="secret", guard=lambda t: F.contains(t, F.lit("eyJ")), valid=_jwt_valid),
    Rule("CONNECTION_STRING", CONNECTION_STRING, "i", "secret", guard=lambda t: F.contains(t, F.lit("://"))),
    Rule("SECRET", LABELLED_SECRET, "i", "secret", mark="$1" + chr(0xE000) + "$2" + chr(0xE001),
         guard=names(":", "="), valid=has("[0-9]|[^A-Za-z]")),
]


def custom_rules(config: Config, spark=None) -> list[Rule]:
    """User patterns; one that does not compile is skipped."""
    rules = []
    for item in config.custom_patterns:
        source = item.get("pattern") or item.get("regex")
        if not source:
            continue
        flags = "".join(f for f in (item.get("flags") or "") if f in "isum")
        prefix = f"(?{flags})" if flags else ""
        if compiles(prefix + source, spark):
            name, via = item.get("type") or item.get("name") or "CUSTOM", item.get("via") or "custom"
            if item.get("of"):
                rules += [_refined(r, name, prefix + source, via, item.get("validate")) for r in BUILTIN if r.key == item["of"]]
            else:
                rules.append(Rule(name, prefix + source, via=via, raw=True, valid=item.get("validate")))
    return rules


def _refined(rule: Rule, name: str, pattern: str, via: str, validate: Callable[[Column], Column] | None) -> Rule:
    """``rule`` under another name, for the matches that ``pattern`` fits from end to end and ``validate`` lets through."""
    tests = [r for r in (rule.valid, has(rf"\A(?:{pattern})\z"), validate) if r]
    return replace(rule, type=name, name=name, via=via, grade=None, valid=lambda v: reduce(lambda a, b: a & b, [test(v) for test in tests]))


def register_rule(
    config: Config, type: str, pattern: str, validate: Callable[[Column], Column] | None = None, via: str = "custom", flags: str = "", arrow: bool = False,
    of: str | None = None,
) -> Config:
    """``config`` with one more rule, which every pass over texts, records and streams then applies.

    ``validate`` turns the matched value into a boolean column; matches for which it is false or null are dropped. ``via`` is the
    evidence the rule gives: with ``custom`` it outranks built-in rules of up to rank 105, with ``checksum`` or ``structural`` its
    values are certain as well, and are looked for again in their session. ``arrow`` marks a validator that is a pandas UDF:
    it works on rows of matches, not inside arrays, so ``plans.redact.find`` then takes matches as rows, and streams refuse it.
    A pattern that does not compile is skipped where the rules are built. ``of`` names a built-in rule of which this is a
    kind: then the pattern has to fit a match of that rule from end to end, so no value is cut short.
    """
    item = {"type": type, "pattern": pattern, "flags": flags, "validate": validate, "via": via, "arrow": arrow, "of": of}
    return config.with_(custom_patterns=(*config.custom_patterns, item))


def needs_rows(config: Config) -> bool:
    """Whether a validator of ``config`` works on rows only."""
    return any(item.get("arrow") for item in config.custom_patterns)


def compiles(pattern: str, spark=None) -> bool:
    """Whether Spark's regex engine accepts a pattern."""
    if spark is None:
        try:
            re.compile(pattern)
            return True
        except re.error:
            return False
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # the JVM's PatternSyntaxException arrives wrapped in one of several types
        return False


def term_rule(config: Config) -> list[Rule]:
    """Always-mask literals as one alternation, longest first."""
    terms = sorted((t for t in config.custom_terms if t), key=len, reverse=True)
    if not terms:
        return []
    body = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in terms)
    return [Rule("CUSTOM", rf"(?iu)(?<!\w)(?:{body})(?!\w)", via="term", raw=True)]


def lookalike_rule(config: Config) -> list[Rule]:
    """Text that already looks like one of our tokens."""
    pre, suf = config.token_prefix, config.token_suffix
    if not pre or not suf:
        return []
    quote = lambda s: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)
    pattern = quote(pre) + r"[A-Z][A-Z0-9_]*_\d+" + quote(suf)
    return [Rule("LITERAL", pattern, via="token_literal", raw=True, guard=lambda t: F.contains(t, F.lit(pre)))]


def value_rules(config: Config, spark=None) -> list[Rule]:
    """Built-in and user detectors switched on: what also runs on decoded text."""
    return [r for r in BUILTIN if config.on(r.key) or config.on(r.type)] + custom_rules(config, spark)
