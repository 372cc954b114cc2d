"""Positions of every match of many patterns, in one narrow pass over the texts.

Spark has no function that returns match offsets. Each pattern is therefore applied once with
``regexp_replace``, wrapping its matches in marker characters; splitting at the markers gives
alternating gaps and matches, and running totals of their lengths are the offsets. All patterns of a
job share one scan, nothing is shuffled, and the text itself is dropped before rows multiply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import ALT, CLOSE, OPEN, java, let, unmarked

CONTEXT = 42  # characters kept either side of a match, enough for every context rule
BLOCK, STEP = 256, 64  # elements: of a scan in the row, and of a running sum, which copies half a block for each element


@dataclass(frozen=True)
class Rule:
    """One pattern. ``mark`` says which part of a match is the value (default: all of it)."""

    type: str
    pattern: str
    flags: str = ""
    via: str = "shape"
    name: str | None = None
    mark: str = OPEN + "$0" + CLOSE
    guard: Callable[[Column], Column] | None = None  # cheap test a text must pass before the pattern runs
    valid: Callable[[Column], Column] | None = None  # on the value
    grade: Callable[[Column], Column] | None = None  # value -> via, where evidence decides it
    raw: bool = False  # the pattern is already in Java's dialect
    digit: bool = False  # every match that counts holds a digit from 0 to 9, so texts without any are passed over
    first: str = ""  # what every match starts with: looked for ahead of the pattern's border, which costs more at each character

    @property
    def key(self) -> str:
        return self.name or self.type

    @property
    def regex(self) -> str:
        ahead = f"(?={self.first})" if self.first else ""
        return self.pattern if self.raw else java(ahead + self.pattern, self.flags)


# Marks for patterns of the form (label)(value): the label stays part of the gap.
LABELLED = "$1" + OPEN + "$2" + CLOSE
# ... and of the form (label:)(value)|(label )(value): the first kind ends with ALT, the second starts with it.
EITHER = "$1$3" + OPEN + "$2" + ALT + "$4" + CLOSE


def running_starts(lengths: Column) -> Column:
    """Offset of each element given the elements' lengths, in blocks so that long arrays stay cheap."""

    def fold(items, first):
        seed = F.array(first)
        return F.aggregate(items, seed, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def total(items):
        return F.aggregate(items, F.lit(0), lambda a, n: a + n)

    def blocks(ls):
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / STEP).cast("int")),
            lambda b: F.slice(ls, b * STEP + 1, F.lit(STEP)),
        )

    def within(bs):
        bases = fold(F.transform(bs, total), F.lit(0))
        parts = F.zip_with(bs, F.slice(bases, 1, F.size(bs)), lambda b, base: F.slice(fold(b, base), 1, F.size(b)))
        return F.flatten(parts)

    return let(lengths, lambda ls: let(blocks(ls), within))


def _plain(part: Column, alt: bool = True) -> Column:
    """A gap or match without ``ALT``, which only some marks set."""
    return F.when(F.contains(part, F.lit(ALT)), F.replace(part, F.lit(ALT), F.lit(""))).otherwise(part) if alt else part


def _has_alt(rules: list[Rule]) -> bool:
    return any(ALT in r.mark for r in rules)


def _cut(text: Column, regex: str, mark: str) -> Column:
    """Alternating gaps and matches, NULL without a match. Both borders get one character, as that splits without a regex."""
    marked = F.regexp_replace(text, F.lit(regex), F.lit(mark.replace(CLOSE, OPEN)))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), F.split(m, OPEN, -1)))


def _located(parts: Column, alt: bool = True) -> Column:
    """Matches with their offsets out of an alternating array of gaps and matches. A single match starts where the first gap ends."""
    starts = running_starts(F.transform(parts, lambda p: F.length(_plain(p, alt))))
    every = F.filter(F.arrays_zip(parts.alias("p"), starts.alias("s")), lambda z, i: i % 2 == 1)
    one = F.array(F.struct(F.get(parts, F.lit(1)).alias("p"), F.length(_plain(F.get(parts, F.lit(0)), alt)).alias("s")))
    return F.when(F.size(parts) == 3, one).otherwise(every)


def locate(text: Column, regex: str, mark: str = OPEN + "$0" + CLOSE) -> Column:
    """Array of ``{p: match, s: offset}`` for one pattern within a row; ``text`` must be marker-free."""
    parts = F.split(F.regexp_replace(text, F.lit(regex), F.lit(mark.replace(CLOSE, OPEN))), OPEN, -1)
    return let(parts, lambda ps: _located(ps, ALT in mark))


def with_context(text: Column, spans: Column, *extra: str, context: int = CONTEXT) -> Column:
    """Add the characters around each ``{start_at, end_at, value, ...}`` of an array."""

    def add(s):
        return F.struct(
            *[s[n].alias(n) for n in ("start_at", "end_at", "value", *extra)],
            F.substring(text, F.greatest(s["start_at"] - context, F.lit(0)) + 1, F.least(s["start_at"], F.lit(context))).alias("before"),
            F.substring(text, s["end_at"] + 1, F.lit(context)).alias("after"),
        )

    return F.transform(spans, add)


def _rule_parts(body: Column, rules: list[Rule]) -> Column:
    """For each rule that matches: its number, and the alternating gaps and matches."""

    def parts(rule: Rule, digits: Column) -> Column:
        tests = [*([digits] if rule.digit else []), *([rule.guard(body)] if rule.guard else [])]
        found = _cut(body, rule.regex, rule.mark)
        return F.when(reduce(lambda a, b: a & b, tests), found) if tests else found

    def per_rule(digits: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("rule"), parts(r, digits).alias("parts")) for i, r in enumerate(rules)])

    each = let(body.rlike("[0-9]"), per_rule) if any(r.digit for r in rules) else per_rule(F.lit(True))
    return F.filter(each, lambda r: F.size(r["parts"]) > 1)


def _described(body: Column, part: Column, start: Column, context: int, alt: bool, *head: Column) -> Column:
    def described(value, around):
        ahead, size = F.least(start, F.lit(context)), F.length(value)
        return F.struct(
            *head,
            start.alias("start_at"),
            (start + size).alias("end_at"),
            value.alias("value"),
            (part.endswith(ALT) if alt else F.lit(False)).alias("explicit"),
            (F.left(around, ahead) if context else F.lit("")).alias("before"),
            (F.substring(around, ahead + size + 1, F.lit(context)) if context else F.lit("")).alias("after"),
        )

    def with_around(value):
        # characters are counted from the start of a text, so both sides are taken out of it at once
        begin = F.greatest(start - context, F.lit(0))
        return let(F.substring(body, begin + 1, start - begin + F.length(value) + context), lambda around: described(value, around))

    return let(_plain(part, alt), with_around) if context else described(_plain(part, alt), None)


def hits_in(body: Column, rules: list[Rule], context: int = CONTEXT) -> Column:
    """What ``find_spans`` gives as rows, as one array; ``body`` must be marker-free."""
    alt = _has_alt(rules)
    each = lambda r: F.transform(_located(r["parts"], alt), lambda z: _described(body, z["p"], z["s"], context, alt, r["rule"].alias("rule")))
    return F.flatten(F.transform(_rule_parts(body, rules), each))


def find_spans(df: DataFrame, rules: list[Rule], keys: list[str], text: str = "text", context: int = CONTEXT) -> DataFrame:
    """One row per raw match: ``keys, rule, start_at, end_at, value, explicit, before, after``.

    ``rule`` is the index in ``rules``. Offsets count characters from 0.
    """
    body = F.col("_text")
    marked = (
        df.where(F.length(text) > 0)
        .select(*keys, unmarked(F.col(text)).alias("_text"))
        .select(*keys, "_text", F.explode(_rule_parts(body, rules)).alias("_r"))
        .select(*keys, "_text", F.col("_r.rule").alias("rule"), F.col("_r.parts").alias("_parts"))
    )
    alt = _has_alt(rules)
    hits = F.transform(_located(F.col("_parts"), alt), lambda z: _described(body, z["p"], z["s"], context, alt))
    return marked.select(*keys, "rule", F.explode(hits).alias("_h")).select(*keys, "rule", "_h.*")


def attach_context(found: DataFrame, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Add ``before`` and ``after`` to spans that were found without the text at hand.

    The spans of a text travel as one array, so the text is joined once, not once per span.
    """
    rest = [c for c in found.columns if c not in (*keys, "start_at", "end_at", "value")]
    spans = found.groupBy(*keys).agg(F.collect_list(F.struct("start_at", "end_at", "value", *rest)).alias("_spans"))
    joined = df.select(*keys, F.col(text).alias("_text")).join(spans, keys)
    placed = joined.select(*keys, F.explode(with_context(F.col("_text"), F.col("_spans"), *rest)).alias("_s"))
    return placed.select(*keys, "_s.*")
