"""Document fingerprints by winnowing, all in built-in expressions.

A text's words are letters and digits in lower case. Each word is hashed to a number below a prime; the hash of the K
words from each place on is rolled together by doubling (1, 2, 4, then 4 + 1 words), as polynomials in one base. Of each
WINDOW consecutive hashes the smallest is kept, of equal ones the rightmost; a hash and its place share one 64-bit number,
so a running minimum by doubling finds both. Two texts that share K + WINDOW - 1 words in a row share a fingerprint entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.text import let
from veil.llm.tables import parts

K, WINDOW = 5, 8
WORD = r"[\p{L}\p{N}]+"
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_PLACES = 1 << 31


def _shift(a: Column, n: int) -> Column:
    """``a`` without its first n elements; empty if there are no more."""
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _front(a: Column, n: int) -> Column:
    """``a`` without its last n elements."""
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def _joined(a: Column, b: Column, length: int, more: int, factor: int) -> Column:
    """Polynomials ``a`` of runs of ``length`` words and ``b`` of the ``more`` words behind them, put together."""
    return F.zip_with(_front(a, more), _shift(b, length), lambda x, y: (x * F.lit(factor) + y) % F.lit(_PRIME))


def _grams(hashes: Column) -> Column:
    """Hash of the K words from each place on; of all words if there are fewer."""
    power = [pow(_BASE, i, _PRIME) for i in range(K)]

    def full(h):
        return let(_joined(h, h, 1, 1, power[1]), lambda two: let(_joined(two, two, 2, 2, power[2]), lambda four: _joined(four, h, 4, 1, power[1])))

    def few(h):
        return F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(_BASE) + x) % F.lit(_PRIME)))

    return F.when(F.size(hashes) >= K, full(hashes)).when(F.size(hashes) > 0, few(hashes)).otherwise(F.array().cast("array<long>"))


def _least(a: Column, apart: int) -> Column:
    return F.zip_with(_front(a, apart), _shift(a, apart), lambda x, y: F.least(x, y))


def _minima(packed: Column) -> Column:
    one = F.when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)
    many = let(_least(packed, 1), lambda two: let(_least(two, 2), lambda four: _least(four, 4)))
    return F.when(F.size(packed) >= WINDOW, F.array_distinct(many)).otherwise(one)


def entries(text: Column) -> Column:
    """The fingerprint as an array of numbers, by place: hash * 2^31 + (2^31 - 1 - place). Null is like an empty text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME)))
    packed = let(hashes, lambda h: F.transform(_grams(h), lambda x, i: x * F.lit(_PLACES) + (F.lit(_PLACES - 1) - i)))
    return let(packed, _minima)


def hashes(entry_array: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(entry_array, lambda x: F.shiftright(x, 31)))


def written(entry_array: Column) -> Column:
    """The fingerprint as text: place:hash, by place."""
    return F.array_join(
        F.transform(entry_array, lambda x: F.concat((F.lit(_PLACES - 1) - x.bitwiseAND(F.lit(_PLACES - 1))).cast("string"), F.lit(":"), F.shiftright(x, 31).cast("string"))), " "
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1))))


def with_next(docs: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) in blocks that hold consecutive documents by descending doc_id (null last, rows of one id by
    a hash of the text), columns block, late, id, th. Rows with ``late`` > 0 repeat the first row of the following block, so
    that a window over a block, ordered by late, id descending and th, sees each document's next; after the last comes the first.

    The borders are approximate percentiles of the ids, as many as blocks; a frequent id is cut further by the hash.
    """
    n = n_blocks or parts(docs, 4)
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", "text").withColumn("th", F.xxhash64("text"))
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("c")).first()["c"] or []
    cuts = sorted(cuts, reverse=True)
    step = max(1, int(len(cuts) ** 0.5))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[::step]]) if cuts else F.array().cast("array<long>")

    def above(strict: bool) -> Column:
        # cuts above the id (or at it too): groups of ``step`` whose first is, then those of the last such group
        test = (lambda c: c > F.col("id")) if strict else (lambda c: c >= F.col("id"))
        whole = F.greatest(F.size(F.filter(coarse, test)) - 1, F.lit(0)) * step
        return whole + F.size(F.filter(F.slice(bounds, whole + 1, F.lit(step)), test))

    spread = F.shiftrightunsigned(F.col("th").bitwiseXOR(F.lit(-(1 << 63))), 33) / F.lit(float(1 << 31))
    placed = keyed.withColumns({"lower": above(True), "upper": above(False)}).withColumn(
        "block", (F.col("lower") + F.when(F.col("upper") > F.col("lower") + 1, F.floor(spread * (F.col("upper") - F.col("lower")))).otherwise(F.lit(0))).cast("int")
    ).drop("lower", "upper")
    heads = placed.groupBy("block").agg(F.min(F.struct((-F.col("id").cast("decimal(20,0)")).alias("down"), "th")).alias("head")).orderBy("block").collect()
    if not heads:
        return placed.withColumn("late", F.lit(0))
    # the head of each block also goes to the block before it, that of the first to the last
    cases = [F.struct(F.lit(h["block"]).alias("block"), F.lit(heads[i - 1]["block"]).alias("to"), F.lit(int(-h["head"]["down"])).cast("long").alias("id"), F.lit(h["head"]["th"]).cast("long").alias("th")) for i, h in enumerate(heads)]
    by_block = F.map_from_entries(F.array(*[F.struct(c["block"], F.struct(c["to"], c["id"], c["th"])) for c in cases]))
    head = F.col("head")
    is_head = (F.col("id") == head["id"]) & (F.col("th") == head["th"])
    here = F.struct(F.col("block").alias("block"), F.lit(0).alias("late"))
    both = F.array(here, F.struct(head["to"].alias("block"), F.lit(1).alias("late")))
    return placed.withColumn("head", F.element_at(by_block, F.col("block"))).select("id", "doc_id", "text", "th", F.explode(F.when(is_head, both).otherwise(F.array(here))).alias("at")).select("id", "doc_id", "text", "th", "at.*")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text; null text: empty) with n_chars, its fingerprint, that of its edited text, and
    their likeness to each other and to the next document's.

    One row for each input row. Equal texts have equal fingerprints; a text without words has an empty one. Texts are
    shuffled once, to stand beside the next; repeated rows stand beside each other.
    """
    rows = with_next(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("block").orderBy("late", F.col("id").desc(), "th")
    beside = (
        rows.withColumn("own", entries(F.col("text"))).withColumn("following", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order))
        .where("late = 0")
        .withColumn("changed", edited(F.col("text"), F.col("following")))
        .withColumn("other", entries(F.col("changed")))
    )
    a = hashes(F.col("own"))
    return beside.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("changed", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        a.alias("a"), hashes(F.col("other")).alias("b"), hashes(F.col("next_own")).alias("c"),
    ).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
