"""Nested records: string leaves with their keys, values judged with their key, shapes kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.config import Config
from veil.functions.schemaless import variant_leaves, with_leaves
from veil.operators.detect import FINDING, detect, text_rules
from veil.operators.labels import key_label

# Keys that carry structure rather than content, and keys that hold prose in listings.
STRUCTURAL_KEYS = (
    "filePath file_path path type numLines startLine totalLines originalFile userModified interrupted isImage "
    "returnCodeInterpretation"
).split()
DESCRIPTION_KEYS = "description title summary instructions".split()
BLOB = r"^[A-Za-z0-9+/]{120,}={0,2}$|^(?i:data:[^,]*;base64,)"


def is_blob(c: Column) -> Column:
    """Base64 or data-URI content, which passes through untouched."""
    return (F.length(c) >= 120) & c.rlike(BLOB)


def _leaves(kind: T.DataType, value: Column, path: Column, key: str | None, block_types: tuple[str, ...] | None = None) -> list[Column]:
    """Arrays of ``{field_path, key, value}``, one per string leaf of a column's type.

    With ``block_types``, structs with a ``type`` beside their content are read only if it is one of these.
    """
    if isinstance(kind, T.StringType):
        return [F.array(F.struct(path.alias("field_path"), F.lit(key).cast("string").alias("key"), value.alias("value")))]
    if isinstance(kind, T.VariantType):
        def placed(x):
            return F.struct(F.concat(path, x["field_path"]).alias("field_path"), F.coalesce(x["key"], F.lit(key)).alias("key"), x["value"].alias("value"))

        return [F.transform(variant_leaves(value), placed)]
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            found += _leaves(f.dataType, value[f.name], F.concat(path, F.lit("." + f.name)), f.name, block_types)
        if block_types and "type" in kind.names:
            found = [F.when(value["type"].isin(*block_types), a) for a in found]
        return found
    if isinstance(kind, (T.ArrayType, T.MapType)) and "variant" in kind.simpleString():
        raise ValueError(f"{kind.simpleString()}: variant values inside arrays and maps are not read; make the whole column a variant")
    if isinstance(kind, T.ArrayType):
        if not _leaves(kind.elementType, F.lit(None).cast(kind.elementType), path, key):
            return []

        def inner(v, i):
            every = _leaves(kind.elementType, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), key, block_types)
            return F.flatten(F.filter(F.array(*every), lambda a: a.isNotNull()))

        return [F.flatten(F.transform(value, inner))]
    if isinstance(kind, T.MapType):
        if not _leaves(kind.valueType, F.lit(None).cast(kind.valueType), path, key):
            return []

        def entry(e):
            # leaves that lie directly in the map, or in arrays of it, have the entry's key
            inner = _leaves(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"].cast("string")), None, block_types)
            named = [F.transform(a, lambda x: F.struct(x["field_path"], F.coalesce(x["key"], e["key"].cast("string")).alias("key"), x["value"])) for a in inner]
            return F.flatten(F.filter(F.array(*named), lambda a: a.isNotNull()))

        return [F.flatten(F.transform(F.map_entries(value), entry))]
    return []


def explode_leaves(
    df: DataFrame, id_cols: list[str], skip_keys: tuple[str, ...] = (), only_keys: tuple[str, ...] | None = None, skip_blobs: bool = False,
    block_types: tuple[str, ...] | None = None,
) -> DataFrame:
    """``id_cols, field_path, key, value`` for every string leaf; array elements inherit the array's key."""
    arrays = []
    for f in df.schema.fields:
        if f.name not in id_cols:
            arrays += _leaves(f.dataType, F.col(f.name), F.lit(f.name), f.name, block_types)
    if not arrays:
        return df.select(*id_cols, F.lit("").alias("field_path"), F.lit("").alias("key"), F.lit("").alias("value")).limit(0)
    every = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
    leaves = df.select(*id_cols, F.explode(every).alias("_l")).select(*id_cols, "_l.*").where("value is not null")
    if skip_keys:
        leaves = leaves.where(~F.col("key").isin(list(skip_keys)))
    if only_keys is not None:
        leaves = leaves.where(F.col("key").isin(list(only_keys)))
    return leaves.where(~is_blob(F.col("value"))) if skip_blobs else leaves


def detect_fields(leaves: DataFrame, keys: list[str], config: Config, spark=None) -> DataFrame:
    """Findings of ``{key, value}`` leaves: a telling key is put before the value as a label for detection.

    Spans that touch the label are dropped, the others are shifted back, and their value counts as
    declared (``declared``) because the key said so.
    """
    label = key_label(F.col("key"))
    prefix = F.when(label.isNotNull(), F.concat(label, F.lit(": "))).otherwise("")
    probed = leaves.select(*keys, prefix.alias("_prefix"), F.concat(prefix, "value").alias("_probe"))
    found = detect(probed, text_rules(config, spark), [*keys, "_prefix"], config, text="_probe")
    shift = F.length("_prefix")
    return (
        found.where(F.col("start_at") >= shift)
        .withColumn("start_at", F.col("start_at") - shift)
        .withColumn("end_at", F.col("end_at") - shift)
        .withColumn("declared", shift > 0)
        .select(*keys, *FINDING, "declared")
    )


def map_leaves(kind: T.DataType, value: Column, change: Callable[[Column, Column], Column], path: Column, key: str = "", skip=()) -> Column:
    """Rebuild a value of any nested type with its string leaves changed; every other part stays as it is.

    ``change`` gets the leaf and its path. Keys in ``skip`` keep their values.
    """
    if isinstance(kind, T.StringType):
        return value if key in skip else change(value, path)
    if isinstance(kind, T.VariantType):
        def changed(x):
            new = change(x["value"], F.concat(path, x["field_path"]))
            return F.when(F.coalesce(x["key"], F.lit(key)).isin(list(skip)), x["value"]).otherwise(new) if skip else new

        return F.when(value.isNotNull(), with_leaves(value, F.transform(variant_leaves(value), changed)))
    if isinstance(kind, T.StructType):
        fields = [
            map_leaves(f.dataType, value[f.name], change, F.concat(path, F.lit("." + f.name)), f.name, skip).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(
            value, lambda v, i: map_leaves(kind.elementType, v, change, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), key, skip)
        )
    if isinstance(kind, T.MapType):
        def each(k, v):
            changed = map_leaves(kind.valueType, v, change, F.concat(path, F.lit("."), k.cast("string")), "", skip)
            return F.when(k.cast("string").isin(list(skip)), v).otherwise(changed) if skip else changed

        return F.transform_values(value, each)
    return value


def rewrite_records(df: DataFrame, replacements: DataFrame, id_cols: list[str], skip_keys: tuple[str, ...] = ()) -> DataFrame:
    """Put changed leaves (``id_cols, field_path, new_value``) back into records of unchanged schema."""
    by_path = replacements.groupBy(*id_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("field_path", "new_value"))).alias("_new")
    )
    joined = df.join(by_path, id_cols, "left")

    def change(value, path):
        return F.coalesce(F.try_element_at("_new", path), value)

    columns = [
        F.col(f.name) if f.name in id_cols else map_leaves(f.dataType, F.col(f.name), change, F.lit(f.name), f.name, skip_keys).alias(f.name)
        for f in df.schema.fields
    ]
    return joined.select(*columns)


def withhold_records(df: DataFrame, id_cols: list[str], notice: Column, skip_keys=tuple(STRUCTURAL_KEYS)) -> DataFrame:
    """Replace every content string of a record by a notice (NULL notice: leave the record), keeping its shape."""

    def change(value, path):
        return F.when(value.isNotNull() & notice.isNotNull() & ~is_blob(value), notice).otherwise(value)

    return df.select(*[
        F.col(f.name) if f.name in id_cols else map_leaves(f.dataType, F.col(f.name), change, F.lit(f.name), f.name, skip_keys).alias(f.name)
        for f in df.schema.fields
    ])
