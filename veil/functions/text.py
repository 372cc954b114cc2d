"""Column helpers for text: trimming, normalising, hashing, checksums, decoding. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers and runtimes with Unicode regexes define it (wider than Java's \s).
SPACES = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# Private-use characters that mark the borders of a match inside a text being searched.
OPEN, CLOSE, ALT = chr(0xE000), chr(0xE001), chr(0xE002)
WORD = "A-Za-z0-9_"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java(pattern: str, flags: str = "") -> str:
    r"""Write a rule pattern in Java's dialect.

    Rule patterns use ``\<`` and ``\>`` for the start and end of an ASCII word, because ``\b`` means
    something else on every engine, and ``\s`` for Unicode white space. Java's ``\w`` is ASCII and a single look-up.
    """
    out, in_class, i = [], False, 0
    word = f"[{WORD}]" if "i" in flags and "u" in flags else r"\w"  # without regard to Unicode case a class takes in more
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\<":
            out.append(f"(?<!{word})")
        elif two == r"\>":
            out.append(f"(?!{word})")
        elif two == r"\b":
            out.append(f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
        elif two == r"\s":
            out.append(SPACES if in_class else f"[{SPACES}]")
        elif two == r"\S":
            out.append(f"[^{SPACES}]")
        elif pattern[i] == "\\":
            out.append(two)
        else:
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out.append(pattern[i])
            i -= 1
        i += 2
    prefix = "".join(f for f in "isu" if f in flags)
    if "u" in prefix and "i" not in prefix:
        prefix = prefix.replace("u", "")
    return (f"(?{prefix})" if prefix else "") + "".join(out)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def norm(c: Column) -> Column:
    """The identity of a value: trimmed and lower-cased."""
    return F.lower(trim(c))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def mod97(c: Column) -> Column:
    """ISO 7064 remainder of an account number with its first four characters moved to the end."""
    rotated = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))

    def step(rest, ch):
        letter = ch.between("A", "Z")
        return F.when(letter, (rest * 100 + F.ascii(ch) - 55) % 97).otherwise((rest * 10 + F.ascii(ch) - 48) % 97)

    return F.aggregate(F.split(rotated, ""), F.lit(0), lambda rest, ch: F.when(ch == "", rest).otherwise(step(rest, ch)))


# The Verhoeff multiplication and permutation tables.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]


def verhoeff(c: Column) -> Column:
    """True where a 12-digit string carries a valid Verhoeff check digit."""
    mult = F.lit("".join(str(v) for row in VERHOEFF_D for v in row))
    perm = F.lit("".join(str(v) for row in VERHOEFF_P for v in row))

    def at(table, row, col):
        return F.ascii(F.substring(table, row * 10 + col + 1, F.lit(1))) - 48

    indexed = F.transform(F.split(F.reverse(c), ""), lambda ch, i: at(perm, i % 8, F.ascii(ch) - 48))
    check = F.aggregate(indexed, F.lit(0), lambda acc, p: at(mult, acc, p))
    return c.rlike("^[0-9]{12}$") & (F.when(c.rlike("^[0-9]{12}$"), check) == 0)


def fnv1a36(c: Column) -> Column:
    """32-bit FNV-1a over the characters, written in base 36."""

    def step(h, ch):
        code = F.when(ch == "", F.lit(0)).otherwise(
            F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("bigint")
        )
        # characters beyond the basic plane are two UTF-16 units and are folded one after the other
        high, low = F.shiftright(code, 16), code.bitwiseAND(0xFFFF)
        one = h.bitwiseXOR(low) * F.lit(16777619) % F.lit(1 << 32)
        two = (h.bitwiseXOR(high) * F.lit(16777619) % F.lit(1 << 32)).bitwiseXOR(low) * F.lit(16777619) % F.lit(1 << 32)
        return F.when(ch == "", h).when(code > 0xFFFF, two).otherwise(one)

    h = F.aggregate(F.split(c, ""), F.lit(2166136261).cast("bigint"), step)
    return F.lower(F.conv(h.cast("string"), 10, 36))


def finding_id(type_: Column, value: Column) -> Column:
    return F.concat_ws("::", type_, fnv1a36(norm(value)))


ENTITY = r"&#([0-9]{2,4});"


def unmarked(c: Column) -> Column:
    """Blank the marker characters out of foreign text, keeping its length; a text without any is not rewritten."""
    marked = F.contains(c, F.lit(OPEN)) | F.contains(c, F.lit(CLOSE)) | F.contains(c, F.lit(ALT))
    return F.when(marked, F.translate(c, OPEN + CLOSE + ALT, chr(0xFFFD) * 3)).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Replace decimal character references by the characters they stand for."""
    pieces = F.split(F.regexp_replace(unmarked(c), ENTITY, f"{OPEN}$1{OPEN}"), OPEN)

    def char(number):
        return F.decode(F.unhex(F.lpad(F.hex(number.cast("int")), 4, "0")), "UTF-16BE")

    decoded = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, char(p)).otherwise(p))
    return F.when(c.rlike(ENTITY), F.array_join(decoded, "")).otherwise(c)


def decode_percent(c: Column) -> Column:
    """Undo percent-escapes; NULL where an escape is malformed. A plus sign stays a plus sign."""
    return F.call_function("try_url_decode", F.regexp_replace(c, r"\+", "%2B"))
