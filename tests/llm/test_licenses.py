"""Notices as they are usually printed: wrapped, with and without comment signs."""

import pytest
from pyspark.sql import functions as F

from veil.llm import licenses
from veil.sources.tables import table

# The published notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
PROSE = "The village school was open on the first day of the year and\nthe works of the public were distributed free of charge.\nAll of the rights were reserved by the office."


def _commented(text, sign, close=""):
    return "\n".join(f"{sign} {line}".rstrip() + close for line in text.split("\n"))


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))


def test_wrapped_notices(spark, model):
    rows, want = [], {}
    for family, text in (("MIT", MIT), ("BSD", BSD), ("Apache-2.0", APACHE), ("GPL", GPL)):
        for form in (text, _commented(text, "#"), _commented(text, " *"), _commented(text, "//"), text.replace("\n", "\r\n"), PROSE + "\n\n" + text + "\n \n" + PROSE):
            want[len(rows)] = family
            rows.append((len(rows), form))
    for form in (PROSE, "", None, "\n\n#\n", "word", " ".join(PROSE.split()) * 2000, PROSE.replace("\n", "\n\n") + "\n" * 100_000):
        want[len(rows)] = ""
        rows.append((len(rows), form))
    rows += [(None, MIT), (None, MIT), (1000, "a\n" * 50_000 + "\n" + BSD)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"family": F.lit("x"), "line": F.lit(1)})
    got = licenses.scan(docs, model).collect()
    assert {r.doc_id: r.families for r in got if r.doc_id is not None} == {**want, 1000: "BSD"}
    assert [(r.families, r.n_notices) for r in got if r.doc_id is None] == [("MIT", 2)] * 2
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_probabilities_are_those_of_the_model(spark, model):
    """A plain scorer over the same weights."""
    import math
    import re

    weights = {r.gram: r.w for r in model.weights.collect()}
    docs = spark.createDataFrame([(0, MIT), (1, GPL)], "doc_id int, text string")
    for r in licenses.paragraphs(docs, model).where("line is null").collect():
        block = (MIT, GPL)[r.doc_id].split("\n\n")[r.para]
        words = [w.lower() for w in re.findall(r"[^\W_]+", block)]
        grams = {f"{a} {b}" for a, b in zip(words, words[1:])} & set(weights)
        scores = [b + sum(weights[g][i] for g in grams) for i, b in enumerate(model.bias)]
        e = [math.exp(x - max(scores)) for x in scores]
        assert r.family == model.families[e.index(max(e))] and abs(r.p - max(e) / sum(e)) < 1e-9
