"""String leaves of ``variant`` values, whose shape differs from row to row: read with their paths, and put back in place.

Reading walks the value in an Arrow batch function, the one place here that needs Python: a shape of any depth has no column
expression. Putting back is built in: the JSON form is cut at its string literals, and every other character stays.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = "array<struct<field_path: string, key: string, value: string>>"
PLAIN_KEY = re.compile(r"\w+")
#: A string literal of JSON without blanks, with the colon behind it if it is a key; possessive, so its length costs no stack.
LITERAL = r'("[^"\\]*+(?:\\.[^"\\]*+)*+":?)'
MARK = "\u0001"  # escaped in JSON, so never part of it


def walk(text: str | None) -> list[dict]:
    """Leaves in the order of the text. Elements of an array have the array's key, keys that are no words stand in brackets."""
    found, rest = [], [("", None, json.loads(text))] if text is not None else []
    while rest:
        path, key, value = rest.pop()
        if isinstance(value, str):
            found.append({"field_path": path, "key": key, "value": value})
        elif isinstance(value, list):
            rest += [(f"{path}[{i}]", key, v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, dict):
            rest += [(f"{path}.{k}" if PLAIN_KEY.fullmatch(k) else f"{path}[{json.dumps(k)}]", k, v) for k, v in reversed(value.items())]
    return found


def variant_leaves(value: Column) -> Column:
    """Array of ``{field_path, key, value}``, paths relative to the value; null for null."""

    @F.pandas_udf(LEAF)
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(walk)

    return F.when(value.isNotNull(), leaves(F.to_json(value)))


def with_leaves(value: Column, leaves: Column) -> Column:
    """The value with its string leaves replaced by ``leaves``, one for each in their order; numbers and shape stay as they were.

    Goes through the JSON form: dates, times and bytes that were cast into a variant are strings there, so they are leaves, and come back as strings.
    """
    pieces = F.split(F.regexp_replace(F.to_json(value), LITERAL, MARK + "$1" + MARK), MARK)
    is_leaf = F.transform(pieces, lambda p, i: ((i % 2 == 1) & ~p.endswith('":')).cast("int"))
    # pieces between two leaves belong together: cut at the leaves alone
    gaps = F.split(F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), is_leaf.alias("l")), lambda x: F.when(x["l"] == 1, F.lit(MARK)).otherwise(x["p"])), ""), MARK)
    quoted = F.transform(leaves, lambda s: F.substring(F.to_json(F.array(s)), F.lit(2), F.length(F.to_json(F.array(s))) - 2))
    filled = F.zip_with(gaps, quoted, lambda g, q: F.concat(g, F.coalesce(q, F.lit(""))))  # behind the last leaf stands no other
    return F.parse_json(F.array_join(filled, ""))
