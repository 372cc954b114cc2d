"""License scans: a trained classifier over paragraphs, confirmed by comparison with templates. DataFrame operations only.

Judged are the lines of a text and the paragraphs they form, as notices are often wrapped. Their features are word bigrams. A multinomial logistic regression with a class for
each licence family and one for everything else is fitted on variants of the templates (word ranges of different lengths, with
words left out) and on a bounded sample of the corpus's own lines and of sentences that speak of licences without granting
one. The limit for a family's probability is calibrated on variants and lines held out from the fit. A prediction
counts if the paragraph also holds enough of one of that family's templates.

Applying it, a text's bigrams meet the model's in a join with a broadcast table whose size the templates bound; only
bigrams the model knows go on, and only to be added up by line and paragraph. Texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.session import materialize

# Notices as their licences print them or as projects commonly state them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
}
OTHER = "unknown"
#: Sentences near the subject that grant nothing.
NEAR = (
    "The driver lost the license after the third offence of the year.",
    "A general election was held under the new public law in version two.",
    "All rights reserved by the publisher of this work.",
    "The software was distributed to schools free of charge by the ministry.",
    "The apache helicopter landed in the free zone without permission.",
    "Students may obtain a copy of the schedule at the office.",
    "The foundation published the terms of the public tender.",
    "This work is the third of a series on the creative commons of the village.",
)
#: Lines of the corpus the fit sees at most, and the share of other lines that may pass the limit.
LINES, FALSE_SHARE = 4000, 0.001
#: Share of a template's bigrams that a paragraph must hold to confirm a prediction.
CONFIRMED = 0.7
WORD = r"[\p{L}\p{N}]+"
#: The end of a line and all lines without a word behind it.
PARAGRAPH_END = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"


def bigrams(line: Column) -> Column:
    """Distinct pairs of neighbouring words in lower case; a line of one word has none."""
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, templates: dict = TEMPLATES) -> DataFrame:
    """family, template (number), line."""
    rows = [(family, i, line) for i, (family, line) in enumerate((f, line) for f in sorted(templates) for line in templates[f])]
    return spark.createDataFrame(rows, "family string, template int, line string")


def variants(lines: DataFrame) -> DataFrame:
    """family, line, fold: word ranges that hold two thirds or more of a line, and each with one word in nine left out."""
    words = lines.select("family", F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    ranges = words.withColumn("from", F.explode(F.sequence(F.lit(0), F.floor(n / 3).cast("int")))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - F.col("from"))))
    part = ranges.select("family", F.slice("w", F.col("from") + 1, n - F.col("from") - F.col("cut")).alias("w"), "from", "cut")
    dropped = part.withColumn("skip", F.explode(F.array(F.lit(-1), F.lit(2), F.lit(5)))).select(
        "family", F.array_join(F.filter("w", lambda x, i: (F.col("skip") < 0) | (i % 9 != F.col("skip"))), " ").alias("line")
    )
    return dropped.distinct().withColumn("fold", F.pmod(F.xxhash64("line"), F.lit(5)))


class Classifier:
    """Weights by bigram, biases, the limit for a family's probability; small tables, bounded by templates and ``LINES``."""

    def __init__(self, spark: SparkSession, families: list[str], grams: list[str], weights: list[list[float]], bias: list[float], limit: float, templates: dict):
        self.families, self.bias, self.limit = families, bias, limit
        self.weights = spark.createDataFrame(list(zip(grams, weights)), "gram string, w array<double>")
        lines = template_table(spark, templates).select("family", "template", F.explode(bigrams(F.col("line"))).alias("gram"))
        sizes = lines.groupBy("template").agg(F.count(F.lit(1)).alias("size"))
        self.templates = lines.join(sizes, "template")


def _probabilities(sums: list[Column], bias: list[float]) -> Column:
    """Softmax of the classes' scores, as an array."""
    scores = F.array(*[s + F.lit(b) for s, b in zip(sums, bias)])
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fit(docs: DataFrame, templates: dict = TEMPLATES, lines: int = LINES) -> Classifier:
    """Fit on the templates and on at most ``lines`` lines of ``docs`` (text), chosen by a hash; lines that hold most of a
    template are not taken for others."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select("text")
    known = variants(template_table(spark, templates))
    n = texts.count()
    # a sample of texts first, then of their lines by hash
    some = texts.sample(fraction=min(1.0, lines / max(n, 1)), seed=5).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    some = some.orderBy(F.xxhash64("line", F.lit(11)), "line").limit(lines).select(F.substring("line", 1, 2000).alias("line"))
    held = F.exists(bigrams(F.col("line")), lambda g: g.isin(*_marks(templates)))
    near = spark.createDataFrame([(x,) for x in NEAR], "line string")
    other = some.where(~held).unionByName(near).select(F.lit(OTHER).alias("family"), "line", F.pmod(F.xxhash64("line"), F.lit(5)).alias("fold"))
    rows = materialize(known.unionByName(other).withColumn("grams", bigrams(F.col("line"))).where("size(grams) > 0").select("family", "fold", "grams"))
    families = [*sorted(templates), OTHER]
    place = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    share = rows.groupBy("family").agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.join(F.broadcast(share), "family").withColumns({"label": place.cast("double"), "weight": 1.0 / F.col("rows")})
    # bigrams of templates and of sentences near the subject; those of other lines alone would say nothing about a family
    words = known.select(bigrams(F.col("line")).alias("grams")).unionByName(near.select(bigrams(F.col("line")).alias("grams")))
    vectors = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=1 << 14, binary=True).fit(words.where("size(grams) > 0"))
    train = materialize(vectors.transform(rows.where("fold <> 0")).select("x", "label", "weight").repartition(4))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=60, standardization=False).fit(train)
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray().tolist()
    grams = list(vectors.vocabulary)
    first = Classifier(spark, families, grams, matrix.T.tolist(), bias, 0.5, templates)
    judged = _scores(rows.where("fold = 0").select(F.monotonically_increasing_id().alias("p"), "family", "grams"), first, ["p", "family"])
    best = judged.select("family", F.array_max(F.slice("p_class", 1, len(families) - 1)).alias("p"), F.array_position("p_class", F.array_max("p_class")).alias("at"))
    wrong = best.where(F.col("family") == OTHER).agg(F.percentile_approx("p", 1 - FALSE_SHARE, 10_000)).first()[0]
    right = best.where(F.col("family") != OTHER).agg(F.percentile_approx("p", 0.02, 10_000)).first()[0]
    # between what other lines reach and what nearly all variants reach; other lines decide if the two cross
    first.limit = max(0.5, (wrong + right) / 2 if wrong is not None and right is not None and right > wrong else (wrong or 0.5))
    return first


def _marks(templates: dict) -> list[str]:
    """Bigrams that single out a corpus line as possibly a notice, so that it is no example of other lines."""
    out = set()
    for lines in templates.values():
        for line in lines:
            words = [w for w in "".join(c if c.isalnum() else " " for c in line.lower()).split()]
            out |= {f"{a} {b}" for a, b in zip(words, words[1:]) if {"license", "licensed", "permission", "redistribution", "redistribute", "copyright"} & {a, b}}
    return sorted(out)


def _scores(rows: DataFrame, model: Classifier, keys: list[str]) -> DataFrame:
    """Rows (keys, grams) with ``p_class``; rows without a known bigram get the biases alone."""
    k = len(model.families)
    hits = rows.select(*keys, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = hits.groupBy(*keys).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(k)])
    full = rows.select(*keys).join(sums, keys, "left")
    return full.select(*keys, _probabilities([F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k)], model.bias).alias("p_class"))


def _units(text: Column) -> Column:
    """Array of ``{para, body}``, one for each line that holds a word: the number of its paragraph, and the line with the first
    word of the paragraph's next line, so that pairs of words across a line's end are kept."""
    blocks = F.split(text, PARAGRAPH_END)

    def lines_of(block, number):
        lines = F.split(block, "\n")
        after = F.slice(lines, 2, F.size(lines))
        return F.zip_with(lines, after, lambda a, b: F.struct(number.alias("para"), F.concat_ws(" ", a, F.regexp_extract(b, WORD, 0)).alias("body")))

    return F.flatten(F.transform(blocks, lines_of))


def _summed(hits: DataFrame, model: Classifier, keys: list[str]) -> DataFrame:
    """Units (``keys``) with their known bigrams (gram, w) and the sums of the weights."""
    return hits.groupBy(*keys).agg(
        *[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(model.families))], F.collect_set("gram").alias("grams"), F.count(F.lit(1)).alias("n")
    )


def _judged(summed: DataFrame, model: Classifier, keys: list[str]) -> DataFrame:
    """The units that the classifier takes for notices, with family, p and share."""
    # a unit has each bigram once; what comes more often comes from equal rows
    once = F.size("grams") / F.col("n")
    p = summed.select(*keys, "grams", _probabilities([F.col(f"s{i}") * once for i in range(len(model.families))], model.bias).alias("p"))
    at = F.array_position("p", F.array_max("p")).cast("int")
    found = p.select(*keys, "grams", F.element_at(F.array(*[F.lit(f) for f in model.families]), at).alias("family"), F.array_max("p").alias("p"))
    found = found.where((F.col("family") != OTHER) & (F.col("p") >= model.limit))
    matched = found.select(*keys, "family", "p", F.explode("grams").alias("gram")).join(F.broadcast(model.templates), ["family", "gram"])
    by_template = matched.groupBy(*keys, "family", "p", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))
    return by_template.groupBy(*keys, "family", "p").agg(F.max("share").alias("share"))


def paragraphs(docs: DataFrame, model: Classifier) -> DataFrame:
    """License notices of ``docs`` (doc_id, text): doc_id, key (hash of the text), para (number from 0), line (number from 0 among
    the lines that hold words; null if the paragraph as a whole is judged), family, p, share (of the template that fits best),
    confirmed.

    Each line is judged, and each paragraph of several lines as a whole, for notices are often wrapped. Lines without letters
    or digits (blank ones, bare comment signs) end a paragraph. Units without a bigram the model knows have the biases' class,
    which is ``unknown``; they are not listed. Null texts have no paragraphs; equal rows are listed once; of classes that tie the
    first by name counts. Texts of any length are read whole, other columns are not read; an empty table gives none.
    """
    ids = ["doc_id", "key"]
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(_units(F.col("text"))).alias("line", "unit"))
    grams = lines.select(*ids, "unit.para", "line", F.explode(bigrams(F.col("unit.body"))).alias("gram"))
    weights = F.broadcast(model.weights)
    by_line = materialize(_summed(grams.join(weights, "gram"), model, [*ids, "para", "line"]))  # texts are read once for both
    single = _judged(by_line, model, [*ids, "para", "line"])
    whole = by_line.groupBy(*ids, "para").agg(F.array_distinct(F.flatten(F.collect_set("grams"))).alias("grams"), (F.min("line") < F.max("line")).alias("several"))
    whole = whole.where("several").select(*ids, "para", F.explode("grams").alias("gram")).join(weights, "gram")
    wrapped = _judged(_summed(whole, model, [*ids, "para"]), model, [*ids, "para"])
    both = single.unionByName(wrapped.withColumn("line", F.lit(None).cast("int")))
    return both.withColumn("confirmed", F.col("share") >= CONFIRMED)


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_lines (not empty), n_notices (confirmed lines, and confirmed paragraphs
    of which no line is), families (comma-joined, sorted), p_family (largest probability, 0 without a notice).

    Null and empty texts have no lines and no notices, equal rows equal results; an empty table gives none.
    """
    alone = F.col("line").isNotNull()
    notices = paragraphs(docs, model).where("confirmed").groupBy("doc_id", "key", "para").agg(
        F.count_if(alone).alias("lines"), F.collect_set(F.when(alone, F.col("family"))).alias("by_line"), F.collect_set("family").alias("any"),
        F.max(F.when(alone, F.col("p"))).alias("p_line"), F.max("p").alias("p_any"),
    )
    counted = notices.select(
        "doc_id", "key", F.greatest("lines", F.lit(1)).alias("n"), F.when(F.col("lines") > 0, F.col("by_line")).otherwise(F.col("any")).alias("names"),
        F.coalesce("p_line", "p_any").alias("p"),
    )
    found = counted.groupBy("doc_id", "key").agg(
        F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))), ",").alias("families"), F.max("p").alias("p_family")
    ).select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), "n_notices", "families", "p_family")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(F.filter(F.split(text, "\n"), lambda x: x != "")).cast("long").alias("n_lines"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("p_family", F.lit(0.0)).alias("p_family")
    )
