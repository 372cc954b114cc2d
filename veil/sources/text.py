"""Sources of text: tables of any format, chat bodies, newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.sources.tables import spread


def read_text(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id", text_col: str = "text", session_col: str | None = None, **options) -> DataFrame:
    """``session_id, doc_id, text`` of a parquet, json, csv, orc or text source."""
    df = spark.read.format(fmt).options(**options).load(path)
    session = F.col(session_col) if session_col else F.lit(0)
    return spread(df.select(session.alias("session_id"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "session_id", "doc_id")


def write_bucketed(corpus: DataFrame, name: str, buckets: int = 256) -> None:
    """Save a corpus as a table bucketed by its keys: joining findings back then moves only the findings."""
    corpus.write.mode("overwrite").bucketBy(buckets, "session_id", "doc_id").sortBy("session_id", "doc_id").saveAsTable(name)


def read_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Flat chat turns as a corpus with one session per conversation."""
    return df.select(F.col(conv).alias("session_id"), F.col(turn).alias("doc_id"), F.col(text).alias("text"))


def message_texts(df: DataFrame, keys: list[str], content: str = "content", system: str | None = None) -> DataFrame:
    """Texts of chat messages whose content is an array of blocks: ``keys, field_path, text``.

    Blocks are ``struct<type, text, content, input: map<string,string>>``. Text blocks, tool results and
    the inputs of tool calls are read; images and other blocks are left alone.
    """
    def entry(path, value):
        return F.struct(path.alias("field_path"), value.alias("text"))

    def of_block(b, i):
        at = F.concat(F.lit(f"{content}["), i.cast("string"), F.lit("]"))
        none = F.slice(F.array(entry(at, b["text"])), 1, 0)
        inputs = F.transform(F.map_entries(b["input"]), lambda e: entry(F.concat(at, F.lit(".input."), e["key"]), e["value"]))
        return (
            F.when(b["type"] == "text", F.array(entry(F.concat(at, F.lit(".text")), b["text"])))
            .when(b["type"] == "tool_result", F.array(entry(F.concat(at, F.lit(".content")), b["content"])))
            .when(b["type"] == "tool_use", F.coalesce(inputs, none))
            .otherwise(none)
        )

    blocks = F.flatten(F.transform(F.col(content), of_block))
    if system:
        blocks = F.concat(F.array(entry(F.lit(system), F.col(system))), blocks)
    return df.select(*keys, F.explode(blocks).alias("_b")).select(*keys, "_b.*").where("text is not null")


NDJSON_SCHEMA = "id string, method string, params string, result string"  # an id may be a number, a string or absent


def parse_ndjson(lines: DataFrame, schema: str = NDJSON_SCHEMA, column: str = "value") -> DataFrame:
    """Records of a stream or table of JSON lines; lines that do not parse are dropped."""
    parsed = F.from_json(F.trim(F.col(column)), schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    records = lines.where(F.ltrim(F.col(column)).startswith("{")).select(parsed.alias("_r"))
    return records.select("_r.*").where("_broken is null").drop("_broken")


def read_ndjson_stream(spark: SparkSession, path: str, schema: str = NDJSON_SCHEMA) -> DataFrame:
    return parse_ndjson(spark.readStream.text(path), schema)


# Methods whose replies carry data, and those that carry descriptions only.
DATA_METHODS = ["tools/call", "resources/read", "resources/list", "resources/templates/list", "prompts/list", "prompts/get"]
DESCRIPTION_METHODS = ["tools/list"]


def route_records(requests: DataFrame, replies: DataFrame, keys: tuple[str, ...] = ("session_id", "id")) -> DataFrame:
    """Replies with how their request says to treat them: ``data``, ``descriptions`` or ``pass``.

    ``requests``: keys, method. ``replies``: keys, result. Ids start anew with each connection, so the session belongs to the
    key. A reply no request asked for passes through; of requests that repeat a key the first method by name counts.
    """
    route = F.when(F.col("method").isin(DATA_METHODS), "data").when(F.col("method").isin(DESCRIPTION_METHODS), "descriptions")
    known = requests.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("method").alias("method"))
    wanted = known.select(*keys, "method", route.alias("_route")).where("_route is not null")
    joined = replies.join(wanted, list(keys), "left")
    return joined.withColumn("route", F.when(F.col("result").isNull(), "pass").otherwise(F.coalesce("_route", F.lit("pass")))).drop("_route")
