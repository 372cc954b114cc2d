import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, path string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]), over a few partitions, with a column no operator asks for."""

    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(parts) if full else spark.createDataFrame([], DOC)

    return build


@pytest.fixture(scope="session")
def prose():
    """Words that look random but always come out the same."""
    import random

    def text(seed, n, words=400):
        r = random.Random(repr(seed))
        return " ".join(f"w{r.randrange(words)}" + r.choice(["", ",", "."]) for _ in range(n))

    return text

