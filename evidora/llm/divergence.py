"""Source divergence audit: how far each source of a language is from the others, and by which terms.

A term is a run of letters of any script (only A-Z are lower-cased). A language keeps the terms of at
least ``LEAST_DOCS`` of its documents. Group and language give every kept term a smoothed share in
billionths, p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)); two shares differ by
floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Pairs of sources are summed sparsely: a term that neither has differs by the same baseline, so a pair
starts at V baselines, and only the terms that one or both have correct it. Terms of one source alone
enter by how many of them share a count; terms of both meet in an equi-join by term.

The highest terms of each group come from a radix selection (``radix_top``): histograms over the digits of
the values find each group's k-th value, then histograms over pieces of the UTF-8 bytes settle ties. No group
is sorted; what is sorted in the end are k rows a group.

Defined cases: null text, language and source are ''; an empty or term-free text makes its group occur; repeated rows count as so many
documents; an empty table gives no rows; a source alone in its language has no pairs; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bytes below 128 that no term holds, once A-Z are lower-cased.
BREAKS = r"[\x00-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["lang", "source"]


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; pre-aggregated in every task."""
    low = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    words = docs.select(*GROUP, F.split(low, BREAKS).alias("words"))
    both = words.select(*GROUP, F.posexplode(F.array(F.col("words"), F.array_distinct("words"))).alias("once", "words"))
    found = both.select(*GROUP, "once", F.explode("words").alias("term")).where("term <> ''")
    return found.groupBy(*GROUP, "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """The smoothed share in billionths; decimals, as the product outgrows a long on large corpora."""
    return F.expr(f"1 + (CAST({count} + 2 AS DECIMAL(20,0)) * {SCALE}BD) DIV CAST({total} + 2 * {kept} AS DECIMAL(20,0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = 32, step: int = 16, chunk: int = 4) -> DataFrame:
    """The ``k`` rows of each group with the highest ``value`` (ties: the item of smaller UTF-8 bytes), with their ``rank``.

    ``value`` is an integer from 0 to 2**bits - 1, items are distinct in a group. Each pass counts rows by group and digit (combined before the
    shuffle, 2**step counts a group at most) and goes on with the digit in which the k-th row lies. Groups of at most k rows keep all.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0)
    at = None
    for shift in range(bits - step, -1, -step):
        digit = F.shiftright(value, shift).alias("digit")
        if at is None:
            counted = rows.groupBy(*keys, digit).agg(F.count("*").alias("ties")).withColumns({"floor": F.lit(0).cast("long"), "need": F.lit(k).cast("long")})
        else:
            inside = rows.join(at.drop("ties"), keys).where(F.shiftright(value, shift + step) == F.col("floor"))
            counted = inside.groupBy(*keys, "floor", "need", digit).agg(F.count("*").alias("ties")).withColumn("digit", F.col("digit") - F.shiftleft("floor", step))
        summed = counted.withColumn("upto", F.sum("ties").over(down)).where("upto >= need AND upto - ties < need")
        at = summed.select(*keys, (F.shiftleft("floor", step) + F.col("digit")).alias("floor"), (F.col("need") - F.col("upto") + F.col("ties")).alias("need"), "ties")
    at = materialize(at)
    code = F.hex(F.encode(item, "UTF-8"))
    tied = materialize(rows.join(at.where("ties > need"), keys).where(F.col(value) == F.col("floor")).select(*keys, "need", code.alias("code")))
    open_, settled, width = tied.select(*keys, "need", F.lit("").alias("last"), "code"), [], 2 * chunk
    up = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    while not open_.isEmpty():
        digit = F.substring(F.col("code"), F.length("last") + 1, F.lit(width)).alias("digit")
        counted = open_.groupBy(*keys, "need", "last", digit).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(up)).where("upto >= need AND upto - n < need")
        edge = materialize(counted.select(*keys, (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.concat("last", "digit").alias("last"), (F.col("n") > F.col("need") - F.col("upto") + F.col("n")).alias("more"), (F.length("digit") == width).alias("longer")))
        settled.append(edge.where("NOT (more AND longer)").select(*keys, "last"))
        open_ = materialize(open_.select(*keys, "code").join(edge.where("more AND longer").select(*keys, "need", "last"), keys).where("startswith(code, last)").select(*keys, "need", "last", "code"))
    last = reduce(DataFrame.unionByName, settled) if settled else at.select(*keys, F.lit("").alias("last")).limit(0)
    bound = at.select(*keys, "floor").join(last, keys, "left")
    chosen = rows.join(bound, keys, "left").where(F.col("floor").isNull() | (F.col(value) > F.col("floor")) | ((F.col(value) == F.col("floor")) & (F.col("last").isNull() | (F.substring(code, F.lit(1), F.length("last")) <= F.col("last")))))
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(item))
    return chosen.select(*rows.columns, F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for every other source of the language, part ``term`` for the top terms."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = Window.partitionBy("lang", "term")
    found = group_terms(docs).withColumns({"everywhere": F.sum("docs").over(each), "total": F.sum("n").over(each), "first": F.min("source").over(each)})
    kept = materialize(found.where(F.col("everywhere") >= least_docs).select(*GROUP, "term", "n", "total", F.col("first") == F.col("source")).toDF(*GROUP, "term", "n", "total", "one"))
    held = kept.groupBy(*GROUP).agg(F.sum("n").alias("size"), F.count_if("one").alias("own"))
    groups = docs.select(*GROUP).distinct().join(held, GROUP, "left").fillna(0, ["size", "own"])
    langs = groups.groupBy("lang").agg(F.sum("size").alias("all"), F.sum("own").alias("kept"))
    stats = materialize(groups.join(langs, "lang").select(*GROUP, "size", "all", "kept", F.when(F.col("kept") > 0, share("0", "size", "kept")).alias("b")))
    shares = kept.join(stats, GROUP).select(*GROUP, "term", share("n", "size", "kept").alias("p"), share("total", "all", "kept").alias("q"), "b")

    other = stats.select("lang", F.col("source").alias("item"), F.col("b").alias("c"))
    couples = materialize(stats.join(other, "lang").where("source <> item").select(*GROUP, "item", "kept", "b", "c"))
    base = couples.select(*GROUP, "item", F.coalesce(F.col("kept") * gap("b", "c"), F.lit(0)).alias("value"))
    alone = shares.groupBy(*GROUP, "p", "b").agg(F.count("*").alias("n")).join(couples.select(*GROUP, "item", "c"), GROUP)  # by group, as languages are few
    alone = alone.groupBy(*GROUP, "item").agg(F.sum(F.col("n") * (gap("p", "c") - gap("b", "c"))).alias("value"))
    left, right = shares.select(*GROUP, "term", "p", "b"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("b").alias("c"))
    shared = left.join(right, ["lang", "term"]).where("source < item").groupBy(*GROUP, "item").agg(F.sum(gap("p", "r") - gap("p", "c") - gap("b", "r") + gap("b", "c")).alias("value"))
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    swapped = shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = reduce(DataFrame.unionByName, [base, alone, mirrored, shared, swapped]).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))))

    higher = materialize(shares.where("p > q").select(*GROUP, F.col("term").alias("item"), gap("p", "q").alias("value")))
    terms = radix_top(higher, GROUP, "value", "item", top)
    named = lambda rows, part: rows.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").unionByName(named(terms, "term"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS size FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY lang),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.size + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.total + 2)) // (l.size + 2 * l.v) AS q
      FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT lang, source, 'pair' AS part, item, coalesce(s.value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums s USING (lang, source, item)),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
