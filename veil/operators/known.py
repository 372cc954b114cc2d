"""Values already known to be personal, found again under other spelling anywhere in their session.

A name is the same name joined by a space, a hyphen or a percent-escape. Known values become a table
of variants, each with a join key (its letters and digits, lower-cased, without separators) and an
exact pattern. Words of the texts meet the first words of known values in an equi-join on session and
word; the runs of words that begin there meet the values' whole keys in a second one, and only then is
the pattern tried. There is no product of values and texts, nor of first and last names, and nothing is
capped unless the configuration says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.text import CLOSE, OPEN, decode_entities, decode_percent, java, norm, unmarked
from veil.operators.detect import FINDING, GATHERED, detect
from veil.operators.encoded import HAS_ESCAPE, HAS_SPELLED, unspell
from veil.operators.intervals import contained, overlapping
from veil.operators.persons import PERSON_RULES
from veil.operators.resolve import precedence
from veil.operators.rules import has, names, names_any_case, value_rules
from veil.operators.spans import CONTEXT, locate
from veil.operators.words import word_array
from veil.session import light, materialize

# Evidence that makes a value certain, and where a lone surname may be looked for.
CERTAIN_VIA = ("checksum", "structural", "secret", "term", "custom", "token_literal", "established", "field")
# A scheme or file name is tried once for each run of its characters, so that a run of any length costs its length. After
# digits or signs, or behind an earlier match, a scheme is looked for inside the run, then over 40 characters at most.
URLISH = (
    r"(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://|[a-z][a-z0-9+.-]{0,40}+://|www\.)[^\s\"'<>]+|/[A-Za-z0-9._~%\-/]{3,}"
    r"|(?<![A-Za-z0-9._~%-])[A-Za-z0-9._~%-]+\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|rtf|zip|png|jpe?g|gif|html?)\>"
)
ZONE_HINT = lambda text: (
    names("/")(text) | names_any_case("www.")(text) | has(r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|rtf|zip|png|jpe?g|gif|html?)(?![a-z0-9_])")(text)
)
SEPARATOR = "(?:%[0-9A-Fa-f]{2}|[^A-Za-z0-9]){0,3}"
SEPARATOR_WIDTH = 9  # three percent-escapes
WORDS = r"(%[0-9A-Fa-f]{2})|([\p{L}\p{M}\p{N}]+)"
WORD_MARK = "$1" + OPEN + "$2" + CLOSE


def ascii_tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(r"[a-z0-9]+(?:['’][a-z0-9]+)*"), F.lit(0))


def has_known_given_name(value: Column, names: list[str]) -> Column:
    """A given name of the list, or any character outside ASCII."""
    return value.rlike(r"[^\x00-\x7f]") | F.exists(ascii_tokens(value), lambda t: t.isin(names))


def is_certain(config: Config) -> Column:
    person_ok = (F.col("type") != "PERSON") | has_known_given_name(F.col("value"), list(config.lexicons.first_names))
    return F.col("via").isin(*CERTAIN_VIA) & person_ok


def certain_values(found: DataFrame, session: str, config: Config) -> DataFrame:
    """``session, norm, declared``: values proved or declared, with the type that ranks highest.

    Where ``found`` has a boolean ``declared``, what a record's key declared is certain as well, whatever it looks like.
    """
    certain = is_certain(config) | F.coalesce("declared", F.lit(False)) if "declared" in found.columns else is_certain(config)
    rank = precedence(F.col("type"), F.col("via"), F.lit(False))
    return (
        found.where(certain)
        .groupBy(session, norm(F.col("value")).alias("norm"))
        .agg(F.min_by("type", F.struct(-rank, F.col("gathered"))).alias("declared"))
    )


def upgrade(found: DataFrame, certain: DataFrame, session: str) -> DataFrame:
    """Weakly evidenced findings of a certain value become established and take its declared type."""
    marks = certain.select(session, F.col("norm").alias("_norm"), F.col("declared").alias("_declared"))
    joined = found.withColumn("_norm", norm(F.col("value"))).join(marks, [session, "_norm"], "left")
    weak = F.col("_declared").isNotNull() & ~F.col("via").isin(*CERTAIN_VIA)
    return (
        joined.withColumn("type", F.when(weak, F.col("_declared")).otherwise(F.col("type")))
        .withColumn("via", F.when(weak, "established").otherwise(F.col("via")))
        .drop("_norm", "_declared")
    )


def url_zones(text: Column) -> Column:
    """Addresses, paths and file names of a text: ``{p, s}``."""
    return locate(text, java(URLISH, "i"))


def disguised_values(corpus: DataFrame, keys: list[str], config: Config, text: str = "text") -> DataFrame:
    """``session, value, type`` of values that exist only in disguise: escaped, spelled out, or in a slug."""
    spark, body = corpus.sparkSession, F.col("_text")
    slugs = F.transform(
        F.filter(url_zones(body), lambda z: z["p"].rlike(r"[_\-]")), lambda z: F.regexp_replace(z["p"], r"[_\-]+", " ")
    )
    variants = F.concat(
        F.when(HAS_ESCAPE(body), F.array(decode_percent(body), decode_entities(body))).otherwise(F.array().cast("array<string>")),
        F.when(ZONE_HINT(body), slugs).otherwise(F.array().cast("array<string>")),
        F.when(HAS_SPELLED(body), F.array(unspell(body))).otherwise(F.array().cast("array<string>")),
    )
    rules = value_rules(config, spark) + (PERSON_RULES if config.on("PERSON") else [])
    told = (
        corpus.select(*keys, unmarked(F.col(text)).alias("_text"))
        .select(*keys, "_text", F.posexplode(variants).alias("_no", "_variant"))
        .where("_variant is not null and _variant <> _text")
        .drop("_text")
    )
    return detect(told, rules, [*keys, "_no"], config, "_variant").select(keys[0], "value", "type").distinct()


def known_values(found: DataFrame, certain: DataFrame, session: str, config: Config, disguised: DataFrame | None = None) -> DataFrame:
    """``session, value, type, sure``: what is worth looking for again.

    Names and addresses always; anything certain as well, except dates of birth. A value on the allow
    list is never looked for.
    """
    values = found.select(session, "value", "type").distinct()
    if disguised is not None:
        values = values.unionByName(disguised).distinct()
    marked = values.withColumn("norm", norm(F.col("value"))).join(
        certain.select(session, "norm", F.lit(True).alias("_c")), [session, "norm"], "left"
    )
    sure = F.coalesce(F.col("_c"), F.lit(False))
    wanted = F.col("type").isin("PERSON", "EMAIL") | (sure & (F.col("type") != "DOB"))
    allowed = sorted({t.strip().lower() for t in config.allow_terms if t.strip()})
    kept = marked.where(wanted & (F.col("type") != "LITERAL"))
    if allowed:
        kept = kept.where(~F.col("norm").isin(allowed))
    return kept.select(session, "value", "type", sure.alias("sure"))


def _literal(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\/&~#-])", r"\\$1")


def _body(parts: Column) -> Column:
    return F.array_join(F.transform(parts, _literal), SEPARATOR)


def _key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]", ""))


def _runs(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), F.lower)


DIGITS, DIGITS_CUT = "0123456789", "#"


def _undigited(key: Column) -> Column:
    return F.concat(F.rtrim(key, F.lit(DIGITS)), F.lit(DIGITS_CUT))


def _variant(kind: str, pieces: Column, pattern: Column, any_case: bool, url_only: bool, when: Column, lead=None, tail=None) -> Column:
    """One way a value may be written; ``pieces`` are its words, any of which may run together in a text."""
    key = F.array_join(pieces, "")
    firsts = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), ""))
    prefix = "(?iu)" if any_case else ""
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("kind"), key.alias("key"), firsts.alias("firsts"), F.concat(F.lit(prefix + "^(?:"), pattern, F.lit(")$")).alias("pattern"),
            F.lit(url_only).alias("url_only"), (lead if lead is not None else F.lit("")).alias("lead"),
            (tail if tail is not None else F.lit("")).alias("tail"),
        ),
    )


KINDS = ("full", "initial", "surname", "exact", "part", "pair")


def variants(known: DataFrame, session: str, config: Config, kinds: tuple[str, ...] = KINDS, corpus: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``session, key, firsts, pattern, kind, url_only, lead, tail, value, type, sure, gathered``; with ``corpus``, pairs that stand in its texts."""
    value, sure = F.col("value"), F.col("sure")
    stop = list(config.lexicons.sweep_stopwords)
    toks, cased = F.col("_toks"), F.col("_cased")
    named = F.col("type").isin("PERSON", "EMAIL")
    several = F.size(toks) >= 2
    surname = F.get(toks, F.lit(1))
    runs = F.col("_runs")
    digits_after = F.lit("[0-9]*")
    made = []
    for ci, parts in ((False, cased), (True, toks)):
        enough = several & (F.size(parts) >= 2)
        if "full" in kinds:
            made.append(_variant("full", runs, F.concat(_body(parts), digits_after), ci, ci, enough))
            made.append(_variant("full", F.slice(runs, 1, 2), F.concat(_body(F.slice(parts, 1, 2)), digits_after), ci, ci, enough & (F.size(toks) > 2)))
        if "initial" in kinds:
            pair = F.array(F.left(F.get(parts, F.lit(0)), F.lit(1)), F.get(parts, F.lit(1)))
            made.append(
                _variant("initial", F.transform(pair, _key), F.concat(_body(pair), digits_after), ci, ci, enough & (F.length(surname) >= 5))
            )
    if "surname" in kinds:
        alone = several & named & (F.length(surname) >= 6) & ~surname.isin(stop)
        made.append(_variant("surname", _runs(surname), F.concat(_literal(surname), digits_after), True, True, alone))
    solid = sure & (F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")) >= 3)
    if "exact" in kinds:
        lead = F.regexp_extract(value, r"^[^\p{L}\p{M}\p{N}]*", 0)
        tail = F.regexp_extract(value, r"[^\p{L}\p{M}\p{N}]*$", 0)
        made.append(_variant("exact", runs, _literal(value), True, False, solid, lead, tail))
    direct = F.filter(F.array(*made), lambda v: v.isNotNull()) if made else None
    if "part" in kinds:
        def part(p):
            bare = F.regexp_replace(p, r"[^\p{L}\p{M}'’\-]", "")
            ok = (F.length(bare) >= 3) & ~F.lower(bare).isin(stop)
            return _variant("part", _runs(bare), _literal(bare), True, False, ok)

        parts = F.when(solid & (F.col("type") == "PERSON"), F.filter(F.transform(F.split(value, java(r"\s+")), part), lambda v: v.isNotNull()))
        direct = parts if direct is None else F.concat(direct, F.coalesce(parts, F.slice(direct, 1, 0)))

    prepared = (
        known.withColumn("_toks", ascii_tokens(value))
        .withColumn("_cased", F.regexp_extract_all("value", F.lit("[A-Za-z0-9]+"), F.lit(0)))
        .withColumn("_runs", _runs(value))
    )
    order = F.when(F.col("type") == "PERSON", GATHERED["sweep"] + 1).otherwise(GATHERED["sweep"] + 2)
    columns = [session, "_v.key", "_v.firsts", "_v.pattern", "_v.kind", "_v.url_only", "_v.lead", "_v.tail", "value", "type", "sure", "gathered"]
    out = None
    if direct is not None:
        out = prepared.select(session, "value", "type", "sure", order.alias("gathered"), F.explode(direct).alias("_v")).select(*columns)
    if "pair" in kinds:
        paired = _pairs(prepared, session, config, corpus, text).select(*columns)
        out = paired if out is None else out.unionByName(paired)
    # digits may follow a value; such a place is keyed without its digits, and marked so
    return out.withColumn("key", F.explode(F.array("key", _undigited(F.col("key"))))).where(F.col("key") != DIGITS_CUT).distinct()


def _pairs(prepared: DataFrame, session: str, config: Config, corpus: DataFrame | None = None, text: str = "text") -> DataFrame:
    """First and last names that were seen apart, put together again; the pair stands for the last name.

    Any name of a session may go with any other; with ``corpus`` those pairs are made that stand in a text of the session, and
    no product of names is built. Only names of the list come first.
    """
    singles = prepared.where((F.col("type") == "PERSON") & (F.size("_toks") == 1))
    if config.paired_names is not None:
        order = Window.partitionBy(session).orderBy(F.desc("sure"), "value")
        singles = singles.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= config.paired_names)
    names = singles.select(session, "value", F.get("_toks", F.lit(0)).alias("t")).distinct()
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    first = names.where(F.col("t").isin(list(config.lexicons.first_names)))
    # a name or an initial may come first for several values; a pair needs one of them that is not its last name
    whose = [F.min("value").alias("_low"), F.max("value").alias("_high")]
    leads = first.groupBy(session, F.col("t").alias("a")).agg(*whose).withColumn("_least", F.lit(3))
    leads = leads.unionByName(first.groupBy(session, F.left("t", F.lit(1)).alias("a")).agg(*whose).withColumn("_least", F.lit(5)))
    leads = leads.withColumn("lead", _key(a))
    last = names.where(F.length("t") >= 3).select(session, F.col("t").alias("b"), F.col("value").alias("v")).withColumn("rest", F.rtrim(_key(b), F.lit(DIGITS)))
    pairs = leads.join(last, session)
    if corpus is not None:
        met = _neighbours(corpus, leads, last, session, text)
        pairs = leads.join(met, [session, "lead"]).join(last, [session, "rest"])
    pairs = pairs.where(((F.col("_low") != v) | (F.col("_high") != v)) & (F.length(b) >= F.col("_least")))
    forms = [_variant("pair", F.array(_key(a), _key(b)), F.concat(_body(F.array(a, b)), F.lit("[0-9]*")), ci, ci, F.lit(True)) for ci in (False, True)]
    return pairs.select(
        session, v.alias("value"), F.lit("PERSON").alias("type"), F.lit(False).alias("sure"), F.lit(GATHERED["sweep"]).alias("gathered"),
        F.explode(F.array(*forms)).alias("_v"),
    )


def _text_words(text: str) -> Column:
    """The words of a text, without the percent-escapes between them."""
    return F.array_remove(F.regexp_extract_all(unmarked(F.col(text)), F.lit(WORDS), F.lit(2)), "")


def _neighbours(corpus: DataFrame, leads: DataFrame, last: DataFrame, session: str, text: str) -> DataFrame:
    """``session, lead, rest``: keys of first and last names that stand side by side or run together in a text of their session.

    Every place gives at most one pair for each length of first names, so the work and the pairs grow with texts and names.
    """
    runs = lambda c: F.size(_runs(c))
    sized = leads.groupBy(session).agg(F.collect_set(F.length("lead")).alias("_sizes"), F.max(runs(F.col("a"))).alias("_f"))
    sized = sized.join(last.groupBy(session).agg(F.max(runs(F.col("b"))).alias("_l")), session)
    sized = materialize(sized)  # a row for each session that has both
    most = sized.agg(F.max(F.col("_f") + F.col("_l"))).first()[0] or 2  # words of a pair; more than two where a name has an apostrophe
    words = F.col("_words")
    beside = [(words if k == 0 else F.slice(words, k + 1, F.size(words))).alias(f"w{k}") for k in range(most)]
    spoken = (
        corpus.join(light(sized.select(session, "_sizes")), session)
        .select(session, "_sizes", _text_words(text).alias("_words"))
        .select(session, "_sizes", F.explode_outer(F.arrays_zip(*beside)).alias("_z"))
        .where("_z is not null")
    )
    spoken = spoken.select(session, "_sizes", *[F.lower(F.concat(*[f"_z.w{k}" for k in range(n + 1)])).alias(f"c{n}") for n in range(most)])

    def cuts(n):
        whole = F.col(f"c{n}")
        ends = lambda size: (size < F.length(whole)) & (F.lit(n == 0 or most > 2) | (size == F.length("c0")))
        cut = lambda size: F.struct(F.left(whole, size).alias("lead"), F.rtrim(F.substring(whole, size + 1, F.length(whole)), F.lit(DIGITS)).alias("rest"))
        return F.when(whole.isNotNull(), F.transform(F.filter("_sizes", ends), cut)).otherwise(F.array().cast("array<struct<lead:string,rest:string>>"))

    return (
        spoken.select(session, F.explode_outer(F.concat(*[cuts(n) for n in range(most)])).alias("_c"))
        .select(session, "_c.lead", "_c.rest")
        .join(light(leads.select(session, "lead").distinct()), [session, "lead"], "left_semi")
        .join(light(last.select(session, "rest").distinct()), [session, "rest"], "left_semi")
        .distinct()
    )


def _following(whole: Column, start: Column) -> Column:
    return F.substring(whole, F.length(start) + 1, F.lit(1))


def first_words(forms: DataFrame, session: str) -> DataFrame:
    """``session, item`` and how far to read on behind such a word: what a form may begin with, and the sizes of those forms.

    ``sizes`` are the lengths of the keys, negative for keys without the digits at their end; ``nexts`` the characters that follow
    the word in the forms' own words, empty where none does; ``words``, ``gap``, ``lead`` and ``tail`` the most words, characters
    between words, and signs before and after that any of the forms has.
    """
    key = F.col("key")
    size = F.when(F.endswith(key, F.lit(DIGITS_CUT)), 1 - F.length(key)).otherwise(F.length(key))
    items = F.array_distinct(F.concat("firsts", F.transform("firsts", lambda x: F.rtrim(x, F.lit(DIGITS)))))
    return (
        forms.select(
            session, F.explode(items).alias("item"), F.element_at("firsts", -1).alias("whole"), size.alias("size"), F.size("firsts").alias("words"),
            F.length("value").alias("long"), F.length("lead").alias("lead"), F.length("tail").alias("tail"), "url_only",
        )
        .where("item <> ''")
        .groupBy(session, "item")
        .agg(
            F.collect_set("size").alias("sizes"), F.collect_set(_following(F.col("whole"), F.col("item"))).alias("nexts"), F.max("words").alias("words"),
            F.max(F.greatest(F.lit(SEPARATOR_WIDTH) * F.col("words"), "long")).alias("gap"),
            F.max("lead").alias("lead"), F.max("tail").alias("tail"), F.max("url_only").alias("zoned"),
        )
    )


def word_runs(corpus: DataFrame, firsts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, key, start_at, end_at, from_at, around, in_zone`` of runs of neighbouring words that may be a known value.

    The words of the sessions that know anything meet the first words of known values in an equi-join; a word that is very
    frequent in one session is a skewed key of that join, whose partitions the adaptive plan splits. Only texts with such words
    are read again, each once. From a hit a run goes on for as many words as the values that begin so have, and counts where it is
    as long as one of them. ``around`` is the run with the characters beside it, so the text is not needed again.
    """
    session, w = keys[0], F.col("_w")
    pieces = lambda body: word_array(body, WORDS, WORD_MARK)
    is_word = lambda x, i: (i % 2 == 1) & (x["p"] != "")
    ends_in_digit = lambda c: F.right(c, F.lit(1)).between("0", "9")
    bare = lambda c: F.rtrim(c, F.lit(DIGITS))
    # the same words as those of the pieces, without their places
    spoken = (
        corpus.join(light(firsts.select(session).distinct()), session, "left_semi")
        .select(*keys, _text_words(text).alias("_words"))
        .select(*keys, F.posexplode_outer(F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.size("_words")).alias("x"))).alias("at", "_z"))
        .select(*keys, "at", F.lower("_z.w").alias("word"), F.col("_z.x").alias("ahead"))
        .where("word is not null")
        .withColumn("item", F.explode(F.when(ends_in_digit(F.col("word")), F.array("word", bare(F.col("word")))).otherwise(F.array("word"))))
    )
    # a form goes on behind the word as the text does: with the word's own digits where it is taken without them, or the next word
    follows = F.when(F.col("word") == F.col("item"), F.lower(F.left("ahead", F.lit(1)))).otherwise(_following(F.col("word"), F.col("item")))
    goes_on = F.array_contains("nexts", "") | F.coalesce(F.array_contains("nexts", follows), F.lit(False))
    hits = (
        spoken.join(light(firsts), [session, "item"])
        .where(goes_on)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("at", "sizes", "words", "gap", "lead", "tail", "zoned")).alias("_hits"))
    )

    def run(h, n):
        part = F.slice(w, h["at"] + 1, n)
        last = F.element_at(part, -1)
        key = F.lower(F.array_join(F.transform(part, lambda x: x["p"]), ""))
        return F.struct(
            key.alias("key"), F.element_at(part, 1)["s"].alias("start_at"), (last["s"] + F.length(last["p"])).alias("end_at"),
            F.element_at(part, 1)["no"].alias("first"), last["no"].alias("last"),
        )

    def fits(h, r):
        size = F.length(r["key"])
        whole = F.array_contains(h["sizes"], size) | (ends_in_digit(r["key"]) & F.array_contains(h["sizes"], -F.length(bare(r["key"]))))
        return whole & (r["end_at"] - r["start_at"] - size <= h["gap"])

    def with_surroundings(h, r):
        from_at = F.greatest(r["start_at"] - h["lead"] - CONTEXT, F.lit(0))
        in_zone = F.exists("_zones", lambda z: (r["start_at"] >= z["s"]) & (r["end_at"] <= z["s"] + F.length(z["p"])))
        # a gap and its word have one character at least; the few beside the run are joined, as the way into a long text is long
        begin = F.greatest(r["first"] - 2 * (h["lead"] + CONTEXT + 1), F.lit(0))
        beside = F.slice("_pieces", begin + 1, r["last"] - begin + 1 + 2 * (h["tail"] + CONTEXT + 1))
        joined = F.array_join(F.transform(beside, lambda x: x["p"]), "")
        around = F.substring(joined, from_at - F.element_at(beside, 1)["s"] + 1, r["end_at"] + h["tail"] + CONTEXT - from_at)
        return F.struct(r["key"].alias("key"), r["start_at"].alias("start_at"), r["end_at"].alias("end_at"), from_at.alias("from_at"), around.alias("around"), in_zone.alias("in_zone"))

    def from_hit(h):
        runs = F.transform(F.sequence(F.lit(1), F.least(h["words"], F.size(w) - h["at"])), lambda n: run(h, n))
        return F.transform(F.filter(runs, lambda r: fits(h, r)), lambda r: with_surroundings(h, r))

    body = F.col("_text")
    numbered = F.transform("_pieces", lambda x, i: F.struct(x["p"].alias("p"), x["s"].alias("s"), F.when(is_word(x, i), i).otherwise(-1).alias("no")))
    zones = F.when(F.exists("_hits", lambda h: h["zoned"]), url_zones(body)).otherwise(F.slice(url_zones(F.lit("")), 1, 0))
    return (
        corpus.select(*keys, unmarked(F.col(text)).alias("_text"))
        .join(hits, keys)
        .select(*keys, "_hits", pieces(body).alias("_pieces"), zones.alias("_zones"))
        .select(*keys, "_hits", "_pieces", "_zones", F.filter(numbered, lambda x: x["no"] >= 0).alias("_w"))
        .select(*keys, F.explode_outer(F.flatten(F.transform("_hits", from_hit))).alias("_r"))
        .where("_r is not null")
        .select(*keys, "_r.*")
        .withColumn("key", F.explode(F.when(ends_in_digit(F.col("key")), F.array("key", _undigited(F.col("key")))).otherwise(F.array("key"))))
        .where(F.col("key") != DIGITS_CUT)
    )


def sweep(corpus: DataFrame, found: DataFrame, known: DataFrame, keys: list[str], config: Config, text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """New findings of known values in other spellings, not counting what ``found`` already covers."""
    session = keys[0]
    known = materialize(known)  # small, and read for the variants and the pairs
    forms = materialize(variants(known, session, config, kinds or KINDS, corpus, text))
    places = word_runs(corpus, materialize(first_words(forms, session)), keys, text).join(light(forms.drop("firsts")), [session, "key"])
    proven = F.col("sure") & (F.col("kind") != "pair")
    surface, start = F.col("surface"), F.col("start_at")

    def around(first, length):
        return F.substring("around", first - F.col("from_at") + 1, length)

    placed = (
        places.withColumn("start_at", start - F.length("lead"))
        .withColumn("end_at", F.col("end_at") + F.length("tail"))
        .where("start_at >= 0")
        .where(~F.col("url_only") | proven | F.col("in_zone"))
        .withColumn("surface", around(start, F.col("end_at") - start))
        .where(((start == 0) | ~around(start - 1, F.lit(1)).rlike("[A-Za-z0-9]")) & ~((surface == F.col("value")) & ~proven))
        .where(F.regexp_like("surface", "pattern"))
        .withColumn("before", around(F.greatest(start - CONTEXT, F.lit(0)), F.least(start, F.lit(CONTEXT))))
        .withColumn("after", around(F.col("end_at"), F.lit(CONTEXT)))
    )
    via = F.when(F.col("sure") & (F.col("kind") != "pair"), "established").otherwise("known_value")
    swept = (
        placed.withColumn("via", via)
        .withColumn("sure", F.col("via") == "established")
        .groupBy(*keys, "start_at", "end_at", "value", "type", "surface", "before", "after")
        .agg(F.min("gathered").alias("gathered"), F.max("sure").alias("sure"), F.min("via").alias("via"))
    )
    return uncovered(swept, found, keys)


def uncovered(swept: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Swept findings without those that overlap a detection; established ones fall only when contained in one."""
    both = swept.withColumn("_seen", F.lit(False)).unionByName(
        found.select(*keys, "start_at", "end_at").withColumn("_seen", F.lit(True)), allowMissingColumns=True
    )
    seen = F.col("_seen")
    hidden = F.when(F.col("sure"), contained(keys, seen)).otherwise(overlapping(keys, seen))
    return both.withColumn("_hidden", hidden).where("not _seen and not _hidden").drop("_seen", "_hidden")


def learn_and_sweep(found: DataFrame, corpus: DataFrame, keys: list[str], config: Config, text: str = "text") -> DataFrame:
    """Candidates after certain values were applied to weak ones and known values were looked for everywhere."""
    session = keys[0]
    certain = certain_values(found, session, config)
    upgraded = upgrade(found, certain, session)
    known = known_values(upgraded, certain, session, config, disguised_values(corpus, keys, config, text))
    swept = sweep(corpus, upgraded, known, keys, config, text)
    columns = [*keys, *FINDING]
    return upgraded.select(*columns, F.lit(False).alias("swept")).unionByName(swept.select(*columns, F.lit(True).alias("swept")))
