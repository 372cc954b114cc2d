"""From raw documents to a training mix: toxicity, near duplicates, benchmark passages, secrets, source weights.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``. Null ids and texts pass
through each stage as its operator says; repeated rows go with the second stage; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import decontaminate, mixing, ngram_join, secrets, tables, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; it is fitted on the labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    chain = toxicity.fit(docs.select("doc_id", "text"), labels)
    docs, restore = tables.hidden(docs, "text")
    return restore(toxicity.judge(docs, chain).where("not rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    docs, restore = tables.hidden(docs, "text")
    marked = decontaminate.mark(docs, bench)
    return restore(marked.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars follows."""
    kind = docs.schema["n_chars"].dataType
    docs, restore = tables.hidden(docs, "text", "n_chars")
    found = secrets.scan(docs)
    some = F.size("found") > 0
    clean = found.withColumn("text", F.when(some, secrets.masked(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    return restore(clean.withColumn("n_chars", F.when(some, F.length("text").cast(kind)).otherwise(F.col("n_chars"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is in it, with the number of its copies and the words they give."""
    mixed = mixing.mix_sources(docs, keep=("lang", "text"))
    return mixed.where("copies > 0").select("doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix),
]

# Trained models and random draws decide here, which SQL can't express: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written under the checkpoint folder."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        from veil.session import materialize

        materialize(spark.range(0))  # sets a scratch folder where none is set, as in tests
        shared = context.getCheckpointDir()
    folder = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
