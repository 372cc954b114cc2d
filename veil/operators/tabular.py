"""Values typed by a table header, by the cell beside them, or by an HTML cell before them.

All of it happens inside a row: lines and cells are arrays with offsets, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import CLOSE, OPEN, SPACES, java, let, trim, unmarked
from veil.operators.detect import GATHERED
from veil.operators.labels import HAS_HEADING, HEADING_WORDS, column_type
from veil.operators.rules import both, has, names, names_any_case
from veil.operators.spans import locate, running_starts, with_context

# each delimiter as it stands and as a pattern
DELIMITERS = [("\t", r"\t"), ("|", r"\|"), (",", ",")]
# the findings of a text as an array
FOUND = "array<struct<type:string,start_at:int,end_at:int,value:string,surface:string,via:string,before:string,after:string,gathered:int>>"
HTML_CELL = r"(<t[dh][^>]*>)([\s\S]*?)(</t[dh]>)"


def _offsets(items: Column, gap: int) -> Column:
    """``{p: item, s: offset, i: index}`` of items that stood ``gap`` characters apart."""
    starts = running_starts(F.transform(items, lambda x: F.length(x) + gap))
    return F.transform(F.arrays_zip(items.alias("p"), starts.alias("s")), lambda z, i: F.struct(z["p"].alias("p"), z["s"].alias("s"), i.alias("i")))


def _cells(line: Column, delim: Column) -> Column:
    """Cells of a located line, with offsets in the text."""
    cells = let(F.split(line["p"], delim["q"], -1), lambda c: _offsets(c, 1))
    return F.transform(cells, lambda c: F.struct(c["p"].alias("p"), (c["s"] + line["s"]).alias("s"), c["i"].alias("i")))


def _value(cell: Column, type_: Column) -> Column:
    lead = F.length(cell["p"]) - F.length(F.regexp_replace(cell["p"], f"^[{SPACES}]+", ""))
    value = trim(cell["p"])
    start = cell["s"] + lead
    return F.struct(start.alias("start_at"), (start + F.length(value)).alias("end_at"), value.alias("value"), type_.alias("type"))


def _filled(s: Column) -> Column:
    return s["type"].isNotNull() & (F.length(s["value"]) > 1) & ~s["value"].rlike("^-+$")


def under_header(lines: Column, delim: Column, header_lines: int | None = 5) -> Column:
    """Values below the first header line of a delimiter, looked for among the first lines (None: all)."""

    def heads(line):
        named = F.exists(F.split(line["p"], delim["q"], -1), lambda c: column_type(c).isNotNull())
        return F.contains(line["p"], delim["d"]) & ~line["p"].rlike("[0-9]{4}|@") & named

    def body(head):
        def typed(columns):
            rows = F.filter(
                lines,
                lambda ln: (ln["i"] > head["i"]) & (F.size(F.split(ln["p"], delim["q"], -1)) == F.size(columns)),
            )
            found = F.flatten(F.transform(rows, lambda ln: F.transform(_cells(ln, delim), lambda c: _value(c, F.get(columns, c["i"])))))
            return F.filter(found, _filled)

        return let(F.transform(F.split(head["p"], delim["q"], -1), column_type), typed)

    return let(F.get(F.filter(lines if header_lines is None else F.slice(lines, 1, header_lines), heads), F.lit(0)), body)


def beside_label(lines: Column, delim: Column) -> Column:
    """Values in the cell after a cell that names a field."""

    def pairs(cells):
        return F.transform(
            F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))),
            lambda c, i: _value(c, column_type(F.get(cells, i)["p"])),
        )

    rows = F.filter(lines, lambda ln: F.contains(ln["p"], delim["d"]))
    found = F.flatten(F.transform(rows, lambda ln: let(_cells(ln, delim), pairs)))
    return F.filter(
        found, lambda s: _filled(s) & column_type(s["value"]).isNull() & ~s["value"].rlike("^[a-z][a-z0-9_]*$")
    )


def html_pairs(body: Column) -> Column:
    """Values in the table cell after a cell that names a field; cells holding markup are left alone."""
    tags = "<[^>]+>"

    def pairs(cells):
        return F.transform(
            F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))),
            lambda c, i: F.when(~c["p"].rlike(tags), _value(c, column_type(F.regexp_replace(F.get(cells, i)["p"], tags, "")))),
        )

    found = let(locate(body, java(HTML_CELL, "i"), "$1" + OPEN + "$2" + CLOSE + "$3"), pairs)
    return F.filter(found, lambda s: s["type"].isNotNull() & (F.length(s["value"]) > 1) & column_type(s["value"]).isNull())


HAS_CELL = both(names("<"), has("(?i)<t[dh]"))
MAY_HEAD = both(names_any_case(*HEADING_WORDS), has(HAS_HEADING))


def _table_spans(body: Column, lines: Column, parts: tuple[str, ...], header_lines: int | None) -> Column:
    """Values of the chosen table shapes, with type and context."""
    delims = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(q).alias("q")) for d, q in DELIMITERS])
    present = F.filter(delims, lambda d: F.contains(body, d["d"]))
    found = []
    if "header" in parts:
        found.append(F.flatten(F.filter(F.transform(present, lambda d: under_header(lines, d, header_lines)), lambda a: a.isNotNull())))
    if "adjacent" in parts:
        found.append(F.flatten(F.transform(present, lambda d: beside_label(lines, d))))
    if "html" in parts:
        found.append(F.when(HAS_CELL(body), html_pairs(body)))
    spans = F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))
    return with_context(body, spans, "type")


def table_findings(body: Column, parts: tuple[str, ...] = ("header", "adjacent", "html"), header_lines: int | None = 5) -> Column:
    """What ``detect_tables`` gives as rows, as one array; ``body`` must be marker-free."""

    def finding(s):
        return F.struct(
            s["type"].alias("type"), s["start_at"].alias("start_at"), s["end_at"].alias("end_at"), s["value"].alias("value"), s["value"].alias("surface"),
            F.lit("field").alias("via"), s["before"].alias("before"), s["after"].alias("after"), F.lit(GATHERED["table"]).alias("gathered"),
        )

    likely = (F.length(body) >= 8) & (HAS_CELL(body) | MAY_HEAD(body))
    spans = let(_offsets(F.split(body, "\n", -1), 1), lambda lines: F.transform(_table_spans(body, lines, parts, header_lines), finding))
    return F.coalesce(F.when(likely, spans), F.array().cast(FOUND))


def detect_tables(df: DataFrame, keys: list[str], parts: tuple[str, ...] = ("header", "adjacent", "html"), text: str = "text", header_lines: int | None = 5) -> DataFrame:
    """Findings (via ``field``) of the chosen table shapes."""
    body = F.col("_text")
    lined = (
        df.where(F.length(text) >= 8)
        .where(HAS_CELL(F.col(text)) | MAY_HEAD(F.col(text)))
        .select(*keys, unmarked(F.col(text)).alias("_text"))
        .withColumn("_lines", _offsets(F.split("_text", "\n", -1), 1))
    )
    return (
        lined.select(*keys, F.explode(_table_spans(body, F.col("_lines"), parts, header_lines)).alias("_s"))
        .select(
            *keys, "_s.type", "_s.start_at", "_s.end_at", "_s.value", F.col("_s.value").alias("surface"),
            F.lit("field").alias("via"), "_s.before", "_s.after", F.lit(GATHERED["table"]).alias("gathered"),
        )
    )
