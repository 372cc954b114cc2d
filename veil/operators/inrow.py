"""The whole chain inside the row: from a text to its resolved findings as one array, without a shuffle and without state.

Everything the batch operators do by grouping findings by text is done here over the text's own array: sorts, and scans that
carry one value along. Scans work in blocks, so their cost stays near linear however many findings a text has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.config import Config
from veil.functions.text import decode_entities, decode_percent, finding_id, java, let, norm, unmarked
from veil.operators import encoded as E
from veil.operators import score as S
from veil.operators.detect import _LABEL_KEYS, _PERSON_KEYS, FINDING, GATHERED, _gathered, text_rules
from veil.operators.labels import first_words, kept_words, name_value, word_norm
from veil.operators.persons import TITLE_BEFORE
from veil.operators.resolve import precedence
from veil.operators.rules import needs_rows, value_rules
from veil.operators.spans import BLOCK, CONTEXT, Rule, hits_in, locate
from veil.operators.tabular import table_findings

_LAST = 2**31 - 1


def scan(items: Column, seed: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running result of ``step`` over an array, its own element included; ``step`` must be associative."""

    def fold(xs, first):
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def blocks(xs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def within(bs):
        bases = fold(F.transform(bs, lambda b: F.aggregate(b, seed, lambda a, x: step(a, x))), seed)
        return F.flatten(F.zip_with(bs, F.slice(bases, 1, F.size(bs)), lambda b, base: F.slice(fold(b, base), F.lit(2), F.size(b))))

    return let(items, lambda xs: F.when(F.size(xs) > 0, let(blocks(xs), within)).otherwise(F.slice(xs, 1, 0)))


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _by_rule(rules: list[Rule], rule: Column, pick: Callable[[Rule], Column | None], otherwise: Column) -> Column:
    chain = F
    for i, r in enumerate(rules):
        answer = pick(r)
        if answer is not None:
            chain = chain.when(rule == i, answer)
    return chain.otherwise(otherwise) if chain is not F else otherwise


def _valid(hits: Column, rules: list[Rule]) -> Column:
    return F.filter(hits, lambda h: F.coalesce(_by_rule(rules, h["rule"], lambda r: r.valid(h["value"]) if r.valid else None, F.lit(True)), F.lit(False)))


def _named(h: Column, config: Config, context: int) -> Column:
    """A label's value cut to the name, NULL where there is none."""

    def cut(v):
        after = F.left(F.concat(F.substring(h["value"], F.length(v) + 1, F.length(h["value"])), h["after"]), F.lit(context))
        return F.when(v.isNotNull(), F.struct(
            h["rule"], h["start_at"], (h["start_at"] + F.length(v)).alias("end_at"), v.alias("value"), h["explicit"], h["before"], after.alias("after"), h["key"], h["via"], h["type"]
        ))

    return let(name_value(h["key"], h["value"], h["explicit"], config.lexicons), cut)


def _judged(h: Column, config: Config) -> Column:
    """A capitalised run cut to the name, NULL where it carries no name signal; ``persons.judge_runs`` for one hit."""
    lex = config.lexicons
    known, stop, titles = list(lex.first_names), list(lex.stopwords), list(lex.honorifics)
    value, is_title, is_caps = h["value"], h["key"] == "TITLE_RUN", h["key"] == "CAPS_RUN"

    def signal(w):
        words, lower = w["words"], w["lower"]
        title_first = F.get(lower, F.lit(0)).isin(titles) & (F.size(words) >= 2)
        title_before = F.lower(F.regexp_extract(F.right(h["before"], F.lit(14)), java(TITLE_BEFORE), 1)).isin(titles)
        position = F.array_position(F.transform(lower, lambda x: x.isin(known)), True)
        anchored = (position > 0) & (position < F.size(words))
        cut_at = F.when(title_first, F.get(words, F.lit(1))).when(title_before, F.get(words, F.lit(0))).when(anchored, F.get(words, (position - 1).cast("int")))
        caps_ok = F.get(lower, F.lit(0)).isin(known) & ~F.exists(lower, lambda x: x.isin(stop))
        begin = F.when(is_title, F.when(~F.forall(lower, lambda x: x.isin(stop)), F.instr(value, cut_at) - 1)).when(is_caps, F.when(caps_ok, 0)).otherwise(0)
        return F.struct(begin.alias("begin"), (title_first | title_before).alias("titled"))

    def whole():
        return h

    def cut(s):
        rest = F.substring(value, s["begin"] + 1, F.length(value))

        def kept(w):
            named = F.exists(w, lambda x: word_norm(x).isin(known))
            fits = ~s["titled"] | named if config.person_mode == "strict" else F.lit(True)

            def result(keep):
                by_name = F.exists(F.slice(w, F.lit(1), keep), lambda x: word_norm(x).isin(known))

                def placed(v):
                    return F.struct(
                        h["rule"], (h["start_at"] + s["begin"]).alias("start_at"), (h["start_at"] + s["begin"] + F.length(v)).alias("end_at"), v.alias("value"), h["explicit"],
                        F.right(F.concat(h["before"], F.left(value, s["begin"])), F.lit(CONTEXT)).alias("before"),
                        F.left(F.concat(F.substring(rest, F.length(v) + 1, F.length(rest)), h["after"]), F.lit(CONTEXT)).alias("after"),
                        h["key"], F.when(by_name, "gazetteer").otherwise("honorific").alias("via"), h["type"],
                    )

                return let(first_words(rest, keep), placed)

            return F.when(fits, let(kept_words(w, lambda x: word_norm(x).isin(stop) & ~F.lower(x).isin(known)), result))

        return F.when(s["begin"] >= 0, F.when(is_title, let(F.split(rest, java(r"\s+")), kept)).otherwise(whole()))

    words = F.split(value, java(r"\s+"))
    return F.when(~h["key"].isin(*_PERSON_KEYS), h).otherwise(let(let(words, lambda w: F.struct(w.alias("words"), F.transform(w, word_norm).alias("lower"))), lambda w: let(signal(w), cut)))


def _unshadowed(hits: Column) -> Column:
    """Without capital runs that overlap another kind of name."""

    def chosen(rows):
        other = lambda h, end: F.when(h["key"].isin("TITLE_RUN", "INITIALS"), h[end])
        before = scan(F.transform(rows, lambda h: F.coalesce(other(h, "end_at"), F.lit(-1))), F.lit(-1), F.greatest)
        after = F.reverse(scan(F.transform(F.reverse(rows), lambda h: F.coalesce(other(h, "start_at"), F.lit(_LAST))), F.lit(_LAST), F.least))
        clear = F.filter(
            F.arrays_zip(rows.alias("h"), before.alias("b"), after.alias("a")),
            lambda z: (z["h"]["key"] != "CAPS_RUN") | ((z["b"] <= z["h"]["start_at"]) & (z["a"] >= z["h"]["end_at"])),
        )
        return F.transform(clear, lambda z: z["h"])

    by_place = lambda hs: F.array_sort(hs, lambda x, y: (F.when(x["start_at"] != y["start_at"], x["start_at"] - y["start_at"]).otherwise(x["end_at"] - y["end_at"])).cast("int"))
    return let(hits, lambda hs: F.when(F.exists(hs, lambda h: h["key"] == "CAPS_RUN"), let(by_place(hs), chosen)).otherwise(hs))


def _finding(h: Column, gathered: Column) -> Column:
    return F.struct(
        h["type"].alias("type"), h["start_at"].alias("start_at"), h["end_at"].alias("end_at"), h["value"].alias("value"), h["value"].alias("surface"), h["via"].alias("via"),
        h["before"].alias("before"), h["after"].alias("after"), gathered.alias("gathered"),
    )


def detection(body: Column, rules: list[Rule], config: Config, context: int = CONTEXT) -> list[Callable[[Column], Column]]:
    """``operators.detect.detect`` for one text: steps from nothing to an array of findings, each a column of its own."""
    names, types, vias = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.key for r in rules], [r.type for r in rules], [r.via for r in rules]))

    def graded(h):
        via = _by_rule(rules, h["rule"], lambda r: r.grade(h["value"]) if r.grade else None, F.get(vias, h["rule"]))
        return F.struct(
            *[h[c] for c in ("rule", "start_at", "end_at", "value", "explicit", "before", "after")],
            F.get(names, h["rule"]).alias("key"), via.alias("via"), F.get(types, h["rule"]).alias("type"),
        )

    steps = [lambda _: F.transform(_valid(hits_in(body, rules, context), rules), graded)]
    if any(r.key in _LABEL_KEYS for r in rules):
        steps.append(lambda hits: _present(F.transform(hits, lambda h: _named(h, config, context))))
    if any(r.key in _PERSON_KEYS for r in rules):
        steps.append(lambda hits: _present(F.transform(hits, lambda h: _judged(h, config))))
        if any(r.key == "CAPS_RUN" for r in rules):
            steps.append(_unshadowed)
    order = F.array(*[F.lit(_gathered(r, i)) for i, r in enumerate(rules)])
    return [*steps, lambda hits: F.transform(hits, lambda h: _finding(h, F.get(order, h["rule"])))]


def hidden(body: Column, config: Config, spark, kinds=("ESCAPED", "SPELLED", "BASE64")) -> list[Callable[[Column], Column]]:
    """``operators.encoded.detect_encoded`` for one text, in steps."""
    rules, inner = [r for r in E.REGION_RULES if r.type in kinds], value_rules(config, spark)
    types = F.array(*[F.lit(r.type) for r in inner])

    def read(h):
        kind = F.get(F.array(*[F.lit(r.type) for r in rules]), h["rule"])
        said = F.when(kind == "ESCAPED", decode_percent(decode_entities(h["value"]))).when(kind == "SPELLED", E.unspell(h["value"])).otherwise(E.decode_base64(h["value"]))
        return let(said, lambda d: F.struct(h.alias("h"), kind.alias("kind"), d.alias("said")))

    def telling(r):
        readable = (r["kind"] != "BASE64") | ((F.length(r["said"]) >= E.MIN_DECODED) & (E.printable_share(r["said"]) >= E.PRINTABLE))
        return r["said"].isNotNull() & (r["said"] != r["h"]["value"]) & readable

    def judged(r):
        found = let(unmarked(r["said"]), lambda d: _valid(hits_in(d, inner, 0), inner))
        best = F.array_max(F.transform(found, lambda x: F.struct(F.length(x["value"]), -x["rule"], -x["start_at"], F.get(types, x["rule"]).alias("type"))))
        blob, h = r["kind"] == "BASE64", r["h"]
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(
            F.when(blob, "SECRET").otherwise(b["type"]).alias("type"), h["start_at"].alias("start_at"), h["end_at"].alias("end_at"),
            F.when(blob, h["value"]).otherwise(r["said"]).alias("value"), h["value"].alias("surface"), F.lit("structural").alias("via"),
            h["before"].alias("before"), h["after"].alias("after"), F.when(blob, GATHERED["encoded"] + 1).otherwise(GATHERED["encoded"]).alias("gathered"),
        )))

    return [lambda _: F.filter(F.transform(hits_in(body, rules, CONTEXT), read), telling), lambda regions: _present(F.transform(regions, judged))]


def outside_base64(found: Column, body: Column) -> Column:
    """Without findings backed by shape alone that lie inside a long base64 run."""

    def clear(runs):
        marks = F.concat(
            F.transform(runs, lambda z: F.struct(z["s"].alias("at"), F.lit(-1).alias("no"), (z["s"] + F.length(z["p"])).alias("reach"))),
            F.transform(found, lambda f, i: F.struct(f["start_at"].alias("at"), i.alias("no"), F.lit(-1).alias("reach"))),
        )

        def covered(ms):
            reach = scan(F.transform(ms, lambda m: m["reach"]), F.lit(-1), F.greatest)
            both = F.filter(F.arrays_zip(ms.alias("m"), reach.alias("r")), lambda z: z["m"]["no"] >= 0)
            inside = F.map_from_arrays(F.transform(both, lambda z: z["m"]["no"]), F.transform(both, lambda z: z["r"]))
            return F.filter(found, lambda f, i: ~f["via"].isin(*E.SHAPE_ONLY) | (F.element_at(inside, i) < f["end_at"]))

        return let(F.array_sort(marks), covered)

    run = E.BASE64_RUN_RULE
    return F.when(run.guard(body) & F.exists(found, lambda f: f["via"].isin(*E.SHAPE_ONLY)), let(locate(body, run.regex), clear)).otherwise(found)


def scored(found: Column) -> Column:
    """``operators.score.score`` for one text's findings; weak ones are dropped."""

    def marks(f):
        near = F.struct(
            S.hotword(f["type"], f["before"], f["after"]).alias("hot"), S.antiword(f["type"], f["via"], f["before"]).alias("anti"),
            S.is_lowercase_person(f["type"], f["via"], f["value"]).alias("low"),
        )
        return let(near, lambda m: let(S.points(f["via"], m["hot"], m["anti"], m["low"]), lambda p: F.when(p >= S.FLOOR, F.struct(
            *[f[c] for c in FINDING], p.alias("points"), (p / 100.0).alias("confidence"), S.level(p).alias("level"),
            S.reason(f["type"], f["via"], m["hot"], m["anti"], m["low"]).alias("reason"), finding_id(f["type"], f["value"]).alias("finding_id"),
        ))))

    return _present(F.transform(found, marks))


def filtered(found: Column, config: Config) -> Column:
    """Allow and reject lists, the floor, and the least number of places for each type."""
    allowed = sorted({w.strip().lower() for w in config.allow_terms if w.strip()})
    tests: list = []
    if allowed:
        tests.append(lambda f: ~norm(f["value"]).isin(allowed))
    if config.reject_ids:
        tests.append(lambda f: ~f["finding_id"].isin(list(config.reject_ids)))
    if config.confidence_floor > 0:
        tests.append(lambda f: f["points"] >= round(config.confidence_floor * 100))
    if tests:
        found = F.filter(found, lambda f: reduce(lambda a, b: a & b, [test(f) for test in tests]))
    needed = {t: n for t, n in config.instance_threshold.items() if n > 1}
    if not needed:
        return found

    def enough(fs):
        places = lambda t: F.size(F.array_distinct(F.transform(F.filter(fs, lambda f: f["type"] == t), lambda f: F.struct(f["start_at"], f["end_at"]))))
        few = F.filter(F.array(*[F.when(places(t) < n, F.lit(t)) for t, n in needed.items()]), lambda t: t.isNotNull())
        return let(few, lambda ts: F.filter(fs, lambda f: ~F.array_contains(ts, f["type"])))

    return let(found, enough)


def resolved(found: Column) -> Column:
    """``operators.resolve.resolve_overlaps`` for one text: leftmost wins, then precedence, then length."""
    ranked = F.transform(found, lambda f: F.struct(
        f["start_at"], (-precedence(f["type"], f["via"], F.lit(False))).alias("_p"), (-f["end_at"]).alias("_e"), f["gathered"], f["type"], f["value"], f.alias("row")
    ))

    def walk(rows):
        kind = lambda rs: F.slice(rs, 1, 0)

        def block(state, rs):
            """One block's findings on top of what was kept before: only the last end matters."""
            return F.aggregate(
                rs, F.struct(state["last"].alias("last"), kind(rs).alias("kept")),
                lambda acc, r: F.when(r["start_at"] >= acc["last"], F.struct((-r["_e"]).alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept"))).otherwise(acc),
            )

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(-1).alias("last"), kind(rows).alias("kept"))
        every = F.aggregate(blocks, start, lambda acc, rs: let(block(acc, rs), lambda b: F.struct(b["last"].alias("last"), F.concat(acc["kept"], b["kept"]).alias("kept"))))
        return F.transform(every["kept"], lambda r: r["row"])

    return F.when(F.size(found) > 1, let(F.array_sort(ranked), walk)).otherwise(found)


def findings_in_row(texts: DataFrame, config: Config | None = None, text: str = "text", name: str = "findings") -> DataFrame:
    """``texts`` with an array of resolved findings: detection, labels, names, tables, hidden forms, grading, filters, overlaps.

    A projection: it runs on a stream as on a table, moves nothing and keeps no state. Null and empty texts have no findings.
    Known values of a session (the sweep) and lists that are tables need more than one text and are not part of it.
    """
    config = config or Config()
    if needs_rows(config):
        raise ValueError("a validator that is a pandas UDF works on rows of matches: use plans.redact.find")
    spark = texts.sparkSession
    body = F.col("_body")

    # each step is a column: a single expression of the whole chain would nest deeper than the analyzer resolves
    families = {"_found": detection(body, text_rules(config, spark), config)}
    if config.encoded:
        families["_hidden"] = hidden(body, config, spark)
    if config.tables:
        families["_typed"] = [lambda _: table_findings(body, header_lines=config.header_lines)]
    out = texts.withColumn("_body", unmarked(F.coalesce(F.col(text), F.lit(""))))
    for column, steps in families.items():
        for step in steps:
            out = out.withColumn(column, step(F.col(column)))
    if len(families) > 1:
        out = out.withColumn("_found", F.concat(*families))
    last = [lambda found: outside_base64(found, body)] if config.encoded else []
    last.append(lambda found: filtered(scored(found), config))
    for step in [*last, resolved]:
        out = out.withColumn("_found", step(F.col("_found")))
    return out.select(*[c for c in texts.columns if c != name], F.col("_found").alias(name))


def finding_rows(found: DataFrame, keys: list[str], name: str = "findings") -> DataFrame:
    """One row for each finding of an array column.

    An outer explode, as the optimizer would push the plain one's test for empty arrays below the projections, and so
    work the whole chain out again for each place that names its result.
    """
    return found.select(*keys, F.explode_outer(name).alias("_f")).where("_f is not null").select(*keys, "_f.*")
