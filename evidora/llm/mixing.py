"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: in turn each
dimension is scaled so that its marginals meet the targets, until all do. A cell's weight over its tokens is
the factor by which its documents should count. A document is kept with that factor over the largest one as
its probability, so that none exceeds 1 and the kept tokens meet the targets; a hash of its id decides, so
that the decision is the same on every run and executor.

Targets are the shares of tokens that each value of a dimension should have. Without explicit ones they
are the tokens' own shares raised to a power below 1 (and scaled to sum to 1), which lifts the
small and lowers the large. Values without a target keep their own share.

A topic is whatever column the caller gives. Without one it is the form of the text, from counts alone: of words,
and of numbers and runs of marks to the word.

Only the table of cells is iterated on. It goes to the driver as long as it has at most ``CELLS`` rows of
``CELL_BYTES`` in all; beyond, the same rounds run as window sums over a checkpointed table.

Defined cases: a null text has no tokens; null source or language is a value of its own, '' ; cells without
tokens have factor 1; repeated rows and ids share a decision; an empty table gives no rows; other columns may have any
names. Targets that no weights can meet (a cell's only source wants more than its only language has) warn.
"""

from __future__ import annotations

import warnings
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Most rounds of raking, and the deviation of any marginal that ends them; powers of the default targets.
ROUNDS, CLOSE, POWERS = 60, 1e-9, {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Largest table of cells on the driver: rows, and bytes of their names.
CELLS, CELL_BYTES = 100_000, 8 << 20
SALT = "mix-1:"
_WORD, _NUMBER, _MARKS = "[^\\x20\\x09-\\x0D]+", "[0-9]+", "[!-/:-@\\[-`{-~]{2,}"


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return _count(text, _WORD)


def form_of(text: Column, tokens: Column) -> Column:
    """The form of a text: by its runs of marks and its numbers to the word, else by its length."""
    return (
        F.when(tokens == 0, "empty").when(_count(text, _MARKS) * 12 >= tokens, "marked").when(_count(text, _NUMBER) * 12 >= tokens, "figures").when(tokens < 50, "short").when(tokens < 1000, "prose").otherwise("book")
    )


def uniform(key: Column) -> Column:
    """A number from 0 to 1 (exclusive) by a hash of the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Weights of the cells once all marginals meet their targets, or after ``rounds`` rounds; ``targets``: for each dimension value to share."""
    total, weight, off = sum(cells.values()), dict(cells), 0.0
    for _ in range(rounds):
        off = 0.0
        for i, target in enumerate(targets):
            sums: dict = defaultdict(float)
            for cell in sorted(weight):
                sums[cell[i]] += weight[cell]
            off = max([off, *(abs(target[v] * total / s - 1) for v, s in sums.items() if s)])
            weight = {c: w * target[c[i]] * total / sums[c[i]] if sums[c[i]] else w for c, w in weight.items()}
        if off < close:
            break
    else:
        warnings.warn(f"raking ended {off:.2g} off its targets after {rounds} rounds", stacklevel=2)
    return weight


def default_targets(sums: dict, power: float) -> dict:
    powered = {v: s**power if s else 0.0 for v, s in sums.items()}
    total = sum(powered[v] for v in sorted(powered)) or 1.0
    return {v: p / total for v, p in powered.items()}


def _own_targets(given: dict, sums: dict) -> dict:
    """Explicit targets, scaled to what the values without one leave."""
    total = sum(sums.values()) or 1.0
    rest = {v: s / total for v, s in sums.items() if v not in given}
    named = sum(given[v] for v in sums if v in given) or 1.0
    return rest | {v: given[v] / named * (1 - sum(rest.values())) for v in sums if v in given}


def _factors_far(cells: DataFrame, targets: dict[str, dict] | None) -> DataFrame:
    """The rounds as window sums, for tables of cells that the driver shouldn't hold."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 1.0
    work = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim in DIMENSIONS:
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("s"))
        if targets and dim in targets:
            given = spark.createDataFrame(sorted(targets[dim].items()), f"{dim} string, given double")
            sums = sums.join(given, dim, "left")
            sides = sums.agg(F.sum("given").alias("named"), F.sum(F.when(F.col("given").isNull(), F.col("s")).otherwise(0.0)).alias("rest")).first()
            share = F.coalesce(F.col("given") / F.lit(sides["named"] or 1.0) * F.lit(1 - (sides["rest"] or 0.0) / total), F.col("s") / total)
        else:
            powered = sums.agg(F.sum(F.pow("s", F.lit(POWERS[dim]))).alias("p")).first()["p"] or 1.0
            share = F.pow("s", F.lit(POWERS[dim])) / F.lit(powered)
        work = work.join(sums.select(dim, share.alias(f"to_{dim}")), dim)
    for _ in range(ROUNDS):
        work = work.withColumn("off", F.lit(0.0))
        for dim in DIMENSIONS:
            work = work.withColumn("sum", F.sum("w").over(Window.partitionBy(dim)))
            by = F.when(F.col("sum") > 0, F.col(f"to_{dim}") * total / F.col("sum")).otherwise(1.0)
            work = work.withColumn("off", F.greatest("off", F.abs(by - 1))).withColumn("w", F.col("w") * by)
        work = materialize(work)
        if (work.agg(F.max("off")).first()[0] or 0.0) < CLOSE:
            break
    return work.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("factor"))


def _described(docs: DataFrame, topic: Column | None) -> DataFrame:
    """(row, source, lang, n_tokens, topic) of each document, all of its own columns within ``row``."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *([] if topic is None else [F.coalesce(topic, F.lit("")).alias("topic")]))
    text, value = F.col("row.text"), lambda c: F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")).alias(c)
    named = own.withColumn("n_tokens", token_count(text))
    return named.select("row", value("source"), value("lang"), "n_tokens", F.col("topic") if topic is not None else form_of(text, F.col("n_tokens")).alias("topic"))


def factors(docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None, bound: int = CELLS) -> tuple[DataFrame, bool]:
    """((source, lang, topic, factor), whether the table is bounded) of (text, source, lang)."""
    cells = materialize(_described(docs, topic).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    size = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.octet_length(d) for d in DIMENSIONS)).alias("bytes")).first()
    if size["n"] > bound or (size["bytes"] or 0) > CELL_BYTES:
        return _factors_far(cells, targets), False
    table = {(r["source"], r["lang"], r["topic"]): float(r["tokens"]) for r in cells.collect()}
    wanted = []
    for i, dim in enumerate(DIMENSIONS):
        sums: dict = defaultdict(float)
        for cell in sorted(table):
            sums[cell[i]] += table[cell]
        wanted.append(_own_targets(targets[dim], sums) if targets and dim in targets else default_targets(sums, POWERS[dim]))
    weight = rake(table, wanted)
    rows = [(*c, weight[c] / table[c] if table[c] else 1.0) for c in sorted(table)]
    return docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, factor double"), True


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None) -> DataFrame:
    """(row, n_tokens, topic, factor, probability, kept): all rows of ``docs``, each within ``row``, and the decision on it."""
    found, bounded = factors(docs, targets, topic)
    largest = found.agg(F.max("factor")).first()[0] or 1.0
    rows = _described(docs, topic).join(F.broadcast(found) if bounded else found, [*DIMENSIONS])
    rows = rows.withColumn("probability", F.col("factor") / F.lit(largest))
    return rows.select("row", "n_tokens", "topic", "factor", "probability", (uniform(F.col("row.doc_id")) < F.col("probability")).cast("int").alias("kept"))


def _oracle() -> str:
    sql = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text,
    CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS n_tokens,
    coalesce(len(regexp_extract_all(text, '{_MARKS}')), 0) AS marks, coalesce(len(regexp_extract_all(text, '{_NUMBER}')), 0) AS numbers
  FROM documents
), t AS (
  SELECT doc_id, source, lang, n_tokens,
    CASE WHEN n_tokens = 0 THEN 'empty' WHEN marks * 12 >= n_tokens THEN 'marked' WHEN numbers * 12 >= n_tokens THEN 'figures'
      WHEN n_tokens < 50 THEN 'short' WHEN n_tokens < 1000 THEN 'prose' ELSE 'book' END AS topic
  FROM d
), c AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM t GROUP BY ALL
), total AS (SELECT sum(tokens) AS n FROM c)"""
    for dim in DIMENSIONS:
        sql += f""", p_{dim} AS (
  SELECT {dim}, CASE WHEN s > 0 THEN pow(s, {POWERS[dim]}) ELSE 0 END AS p FROM (SELECT {dim}, sum(tokens) AS s FROM c GROUP BY {dim})
), to_{dim} AS (SELECT {dim}, p / (SELECT sum(p) FROM p_{dim}) AS share FROM p_{dim})"""
    last = "c"
    for step in range(ROUNDS * len(DIMENSIONS)):
        dim, weight = DIMENSIONS[step % len(DIMENSIONS)], "w" if step else "tokens"
        sql += f""", r{step} AS MATERIALIZED (
  SELECT x.source, x.lang, x.topic, x.tokens, CASE WHEN sum({weight}) OVER (PARTITION BY x.{dim}) > 0
    THEN {weight} * share * (SELECT n FROM total) / sum({weight}) OVER (PARTITION BY x.{dim}) ELSE {weight} END AS w
  FROM {last} x JOIN to_{dim} y ON x.{dim} = y.{dim}
)"""
        last = f"r{step}"
    return sql + f""", f AS (
  SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS factor FROM {last}
)
SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(factor, 6) AS factor, round(factor / (SELECT max(factor) FROM f), 6) AS probability,
  CAST(CAST('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
    < factor / (SELECT max(factor) FROM f) AS INTEGER) AS kept
FROM t JOIN f ON t.source = f.source AND t.lang = f.lang AND t.topic = f.topic
"""


ORACLE_SQL = _oracle()
