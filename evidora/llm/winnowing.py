"""Document fingerprints by winnowing, in DataFrame functions only.

A gram is a run of ``k`` code points, one for every code point that it can begin at; its hash rolls over the
text in UTF-32, where a code point is four bytes. Of every ``w`` neighbouring grams the one with the smallest rank
(31 bits of its hash) is chosen, the rightmost of equals, and kept with its place and its whole 64-bit hash. Two texts that
share a run of ``w + k - 1`` code points share a chosen gram, and its places say where. A rank and a place live in one number,
the rank above less the place below: the smallest number is then the smallest rank and the rightmost of equals.

The windows of the first three quarters are the same in a text and its edited text, and are worked out once.

Neighbours by ascending id come from a window within buckets of ids, with one shuffle of the texts:
the first rows of the following bucket are dealt into each bucket as well.

Defined cases: a null text is the empty text, which has no grams; a text shorter than ``k`` is one gram as
a whole; fewer grams than a window are one window; two empty texts are alike (1), an empty and
another not (0); a null id comes before all others; rows of one id are ordered by the hash of their
text; the next document of the last is the first, of a single document itself; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Code points in a gram, and grams in a window (a power of two).
K, W = 12, 8
_HIGH, _LOW = 0x7FFFFFFF00000000, (1 << 32) - 1
#: Quantiles of the ids, and parts of each at most: the bound of the heads that are broadcast.
QUANTILES, PARTS = 64, 1024
FIRST_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _no_numbers() -> Column:
    return F.array().cast("array<bigint>")


def units(text: Column) -> Column:
    """The text with four bytes for a code point."""
    return F.encode(text, "UTF-32")


def ranked_grams(text: Column, first: Column, k: int = K) -> Column:
    """Rank and place of every gram of ``units`` from the one at code point ``first`` on, as one number each."""

    def of(u: Column) -> Column:  # a variable of a lambda, as a column's bytes would be copied for every gram
        size, begin = F.octet_length(u), first * 4 + 1
        last = size - F.lit(4 * k - 1)
        number = lambda length: lambda p: F.xxhash64(F.substring(u, p, length)).bitwiseAND(F.lit(_HIGH)) - p
        whole = F.when((size > 0) & (first == 0), F.transform(F.array(F.lit(1)), number(size))).otherwise(_no_numbers())
        return F.when(last >= begin, F.transform(F.sequence(begin, F.greatest(last, begin), F.lit(4)), number(F.lit(4 * k)))).otherwise(whole)

    return _let(text, of)


def window_minima(numbers: Column, w: int = W) -> Column:
    """The smallest number of each full window; ``w`` is a power of two. Each pass makes windows two or four times as wide."""

    def wider(wide: int, by: int):
        return lambda x: F.transform(x, lambda a, i: F.least(a, *[F.get(x, i + k * wide) for k in range(1, by)]))

    wide = 1
    while wide < w:
        by = 4 if 4 * wide <= w else 2
        numbers, wide = _let(numbers, wider(wide, by)), wide * by
    return _let(numbers, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - (w - 1), F.lit(0))))


def _one_window(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.array(F.array_min(numbers))).otherwise(numbers)


def winnow(df: DataFrame, text: str, into: str, k: int = K, w: int = W) -> DataFrame:
    """Add the array ``into`` of the chosen numbers of the column ``text``, in order of place."""
    df = df.withColumn(into, ranked_grams(units(F.col(text)), F.lit(0), k))
    return df.withColumn(into, F.when(F.size(into) > w, F.array_distinct(window_minima(F.col(into), w))).otherwise(_one_window(F.col(into))))


def positions(chosen: Column) -> Column:
    """Code points that the chosen grams begin at, from 0."""
    return F.transform(chosen, lambda x: (((-x).bitwiseAND(F.lit(_LOW)) - 1) / 4).cast("int"))


def hashes(chosen: Column, text: Column, k: int = K) -> Column:
    """The 64-bit hashes of the chosen grams of ``units``; ``substring`` itself ends a short text's only gram."""
    return _let(text, lambda u: F.transform(chosen, lambda x: F.xxhash64(F.substring(u, (-x).bitwiseAND(F.lit(_LOW)).cast("int"), F.lit(4 * k)))))


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) of every whole text: the chosen grams and where they begin. No shuffle."""
    rows = winnow(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "chosen", k, w)
    return rows.select("doc_id", hashes(F.col("chosen"), units(F.col("text")), k).alias("hashes"), positions(F.col("chosen")).alias("positions"))


def digest(chosen: Column) -> Column:
    """SHA-256 of the chosen ranks and places."""
    return F.sha2(F.to_json(chosen), 256)


def likeness(both: Column, a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of different hashes each, of which ``both`` are in both."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of (doc_id, text) with their bucket, those at the head of a bucket also at the end of the one before.

    Returns the rows with ``extra`` true on such copies, and the window in which the next row is the
    next document.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("ord"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("ord", [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("q"), F.min("ord").alias("a"), F.max("ord").alias("b")).first()
    edges = sorted({cuts["a"], *cuts["q"], cuts["b"]}) if cuts["a"] is not None else [0]
    parts = max(1, min(PARTS, -(-8 * shuffle_partitions(spark) // QUANTILES)))
    fixed = F.array(*[F.lit(e).cast("bigint") for e in edges])
    at = F.size(F.filter(fixed, lambda e: e <= F.col("ord")))
    low, high = F.element_at(fixed, F.col("__at")).cast("double"), F.element_at(fixed, F.least(F.col("__at") + 1, F.lit(len(edges)))).cast("double")
    share = F.when(high > low, F.floor((F.col("ord").cast("double") - low) / (high - low) * parts)).otherwise(F.lit(0))
    rows = rows.withColumn("__at", at)
    rows = rows.withColumn("bucket", (F.col("__at").cast("bigint") * (parts + 1) + F.least(share, F.lit(parts)))).drop("__at")
    heads = sorted((r["bucket"], r["head"]) for r in rows.select("bucket", "ord").groupBy("bucket").agg(F.min("ord").alias("head")).collect())
    before = [(b, h, heads[i - 1][0]) for i, (b, h) in enumerate(heads)]
    known = F.broadcast(spark.createDataFrame(before, "bucket bigint, head bigint, before bigint"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))
    rows = rows.join(known, "bucket").withColumn("__to", F.explode(F.when(F.col("ord") == F.col("head"), F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "ord", "text", "__to.bucket", "__to.extra", F.xxhash64("text").alias("tie"))
    return rows, Window.partitionBy("bucket").orderBy("extra", "ord", "tie")


def compare_documents(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each document, of its edited text, and likenesses to that and to the next document.

    The edited text has its last quarter of code points replaced by as many first ones of the next.
    """
    rows, order = with_next(docs)
    n = F.col("n_chars").cast("int")
    tail = F.floor(n / 4).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.when(~F.col("extra"), F.concat(F.left("text", n - tail), F.left("next_text", tail))).otherwise(F.lit("")))
    # Windows that begin before ``same`` lie in the part that both texts share.
    rows = rows.withColumn("same", F.when(F.col("extra"), F.lit(0)).otherwise(F.greatest(n - tail - (w + k - 2), F.lit(0))))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("units", units(F.col("text"))).withColumn("edited_units", units(F.col("edited")))
    rows = rows.select("doc_id", "extra", "bucket", "ord", "tie", "n_chars", "same", "edited_sha256", "units", "edited_units", ranked_grams(F.col("units"), F.lit(0), k).alias("grams"), ranked_grams(F.col("edited_units"), F.col("same"), k).alias("edited_grams"))
    rows = rows.withColumn("minima", window_minima(F.col("grams"), w)).withColumn("edited_minima", window_minima(F.col("edited_grams"), w))
    edited = F.concat(F.slice("minima", F.lit(1), F.col("same")), F.col("edited_minima"))
    chosen = F.when(F.size("grams") > w, F.array_distinct("minima")).otherwise(_one_window(F.col("grams")))
    edited_chosen = F.when((F.col("same") > 0) | (F.size("edited_grams") > w), F.array_distinct(edited)).otherwise(_one_window(F.col("edited_grams")))
    rows = rows.withColumn("chosen", chosen).withColumn("edited_chosen", edited_chosen)
    rows = rows.withColumn("own", F.array_distinct(hashes(F.col("chosen"), F.col("units"), k))).withColumn("changed", F.array_distinct(hashes(F.col("edited_chosen"), F.col("edited_units"), k)))
    rows = rows.withColumn("both", F.size(F.array_intersect("own", "changed")))
    rows = rows.select("doc_id", "extra", "bucket", "ord", "tie", "n_chars", "edited_sha256", digest(F.col("chosen")).alias("fingerprint"), digest(F.col("edited_chosen")).alias("edited_fingerprint"), likeness(F.col("both"), F.col("own"), F.col("changed")).alias("near_edited"), "own")
    rows = rows.withColumn("following", F.lead("own").over(order)).where("NOT extra").withColumn("both", F.size(F.array_intersect("own", "following")))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("both"), F.col("own"), F.col("following")).alias("near_next"))
