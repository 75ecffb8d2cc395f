"""Filter interaction audit: what five quality filters remove in every order, and who is answerable for it.

Failures are five bits of a document (``LETTERS``): A under 50 words, B few distinct words, C many capitals, D marks of
markup, E the text of a smaller doc_id. All results of a part follow from how many of its documents have which bits.

With those counts a part has a removal polynomial, the multilinear extension of "removed by a set of filters": the documents
that are removed if filter i works with probability x_i. Its corners are the removals of plain sets of filters, so survivors
of every step of every order are corners. Its partial derivative, integrated along the diagonal, is the Shapley value, an exact
rational with denominators up to five; times 120 it is the sum over all orders.

E needs the first of each group of equal texts. Copies of a text within a part share their bits, so they are counted before they
meet the other parts: a text with any number of copies travels as one row a part.

Defined cases: a null text is empty (no words: fails A, not B or C; equal to other empty texts), a null source is ''; rows without a doc_id have no smaller
one and no labels; repeated rows count each, and none of them makes another of the same doc_id a copy; several labels of an id count as their union; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ALL = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
Counts = list[int]


def text_bits(text: str = "text") -> Column:
    """Bits A to D of a text, as an int; all in one projection without Python."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals.cast("long") * 100 > F.char_length(text).cast("long") * MOST_CAPITALS, F.col(text).rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of every part and set of failures that occurs."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_bits().alias("mask"))
    counted = bits.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n")).withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(0))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    flags = flags.withColumn("salt", F.lit(0).cast("long"))  # rows without an id match nothing, but are dealt over all tasks
    known = counted.join(flags, ["doc_id", "salt"], "left").select("doc_id", "part", "same", "mask", "n", (F.col("n") * F.coalesce("q", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("least")
    copies = known.groupBy("same", "part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least)
    here = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("same"))
    firsts = copies.withColumn("here", F.coalesce(here, F.lit(False)))
    own = {c: F.when(F.col("here"), F.col(f"least.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    kept = F.struct(F.col("mask"), (own["n"] + F.col("nameless")).alias("n"), own["good"].alias("good"), own["toxic"].alias("toxic"))
    gone = F.struct((F.col("mask") + ALL // 2).alias("mask"), (F.col("n") - own["n"] - F.col("nameless")).alias("n"), (F.col("good") - own["good"]).alias("good"), (F.col("toxic") - own["toxic"]).alias("toxic"))
    split = firsts.select("part", F.inline(F.array(kept, gone))).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def polynomial(counts: Counts) -> Counts:
    """Coefficients by set of variables: sum of counts[m] * (1 - product of (1 - x_i) for i in m)."""
    return [0 if s == 0 else (1 if s.bit_count() % 2 else -1) * sum(n for m, n in enumerate(counts) if m & s == s) for s in range(len(counts))]


def corner(coefficients: Counts, chosen: int) -> int:
    """The polynomial where the chosen variables are 1 and the others 0."""
    return sum(c for s, c in enumerate(coefficients) if s & chosen == s)


def diagonal(coefficients: Counts, i: int) -> Fraction:
    """Integral from 0 to 1 of the partial derivative by x_i where all variables are equal."""
    return sum((Fraction(c, s.bit_count()) for s, c in enumerate(coefficients) if s >> i & 1), Fraction(0))


def steps_of(part: str, found: list[dict]) -> list[tuple]:
    """All rows of one part."""
    size, curves = 0, {}
    for name in ("n", "good", "toxic"):
        counts = [0] * ALL
        for x in found:
            counts[x["mask"]] += x[name]
        curves[name] = polynomial(counts)
        if name == "n":
            size, alone = sum(counts), [counts[1 << i] for i in range(len(LETTERS))]
    corners = {name: [corner(c, s) for s in range(ALL)] for name, c in curves.items()}
    fails = [corners["n"][1 << i] for i in range(len(LETTERS))]
    values = [diagonal(curves["n"], i) * len(ORDERS) for i in range(len(LETTERS))]
    rows = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = LETTERS.index(letter)
            after = before | 1 << i
            n, good, toxic = (corners[c][after] - corners[c][before] for c in ("n", "good", "toxic"))
            rows.append((part, order, step, size - corners["n"][after], n, fails[i] - n, alone[i], good, toxic, int(values[i])))
            before = after
    return rows


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]


def _all_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for part in batch.to_pylist():
            columns = zip(*steps_of(part["part"], part["found"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows of every part: all orders and steps. A part travels as its counts, of which there are 32 at most."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    return parts.mapInArrow(_all_orders, SCHEMA)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(t, 0) AS t, (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
        (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce((least < doc_id)::INT, 0) AS e
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, [a, b, c, d, e] AS bits, count(*) AS n, sum(q) AS q, sum(t) AS t FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [v.i, x.i, y.i, z.i, u.i] AS o, substr('ABCDE', v.i, 1) || substr('ABCDE', x.i, 1) || substr('ABCDE', y.i, 1) || substr('ABCDE', z.i, 1) || substr('ABCDE', u.i, 1) AS filter_order
           FROM k v, k x, k y, k z, k u WHERE len(list_distinct([v.i, x.i, y.i, z.i, u.i])) = 5),
s AS (SELECT m.*, filter_order, k.i AS step, o[k.i] AS f, list_sum(list_transform(o[1:k.i - 1], lambda g: bits[g])) AS earlier, bits[o[k.i]] AS fails, list_sum(bits) AS failing FROM m, orders, k),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN coalesce(earlier, 0) = 0 AND fails = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN coalesce(earlier, 0) = 0 AND fails = 1 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN earlier > 0 AND fails = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = 1 AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN coalesce(earlier, 0) = 0 AND fails = 1 THEN q ELSE 0 END) AS good_lost, sum(CASE WHEN coalesce(earlier, 0) = 0 AND fails = 1 THEN t ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
