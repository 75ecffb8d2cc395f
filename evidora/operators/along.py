"""Values along the rows of a file, however long it is: no task sorts or holds more of it than a block of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages a block. Blocks of a file meet by a row each, so that a file of 50 million pages is 100,000 rows where they meet.
BLOCK = 500


def along(rows: DataFrame, order: list[str], upto: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, block: Column | None = None, blocks: bool = True) -> DataFrame:
    """Adds what windows over the whole ``source_file`` would: the last value that isn't null of ``upto`` (the row's own counts) and of
    ``before`` (it doesn't), the first one of ``after`` (it doesn't) and the running totals of ``sums`` (it does).

    ``block`` names a row's block and must ascend with ``order``; by default its first column is a page number. What the other blocks of a file
    come to enters each block as a row in front and one at the end. Without ``blocks`` a file is one: for files that a task can sort, as the
    rows are then computed once instead of twice.
    """
    last, total = {**(upto or {}), **(before or {})}, sums or {}
    if not blocks:
        block = F.lit(0)
    df = rows.withColumn("__block", F.floor(F.col(order[0]) / BLOCK) if block is None else block)
    place, key = F.struct(*order), ["source_file", "__block"]
    met = df.select("*", F.lit(0).alias("__side"), *[c.alias(f"__{n}") for n, c in {**last, **(after or {}), **total}.items()])
    before_it = (Window.unboundedPreceding, -1)
    if blocks:
        values = df.select(*key, place.alias("__place"), *[c.alias(f"__{n}") for n, c in {**last, **(after or {}), **total}.items()])
        there = lambda n: F.when(F.col(f"__{n}").isNotNull(), F.col("__place"))
        ends = values.groupBy(*key).agg(*[F.max_by(f"__{n}", there(n)).alias(f"__{n}") for n in last], *[F.min_by(f"__{n}", there(n)).alias(f"__{n}") for n in after or {}], *[F.sum(f"__{n}").alias(f"__{n}") for n in total])
        earlier, later = (Window.partitionBy("source_file").orderBy(b).rowsBetween(*before_it) for b in (F.asc("__block"), F.desc("__block")))  # a frame that looks ahead is quadratic
        front = ends.select(*key, F.lit(-1).alias("__side"), *[F.last(f"__{n}", True).over(earlier).alias(f"__{n}") for n in last], *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in total])
        met = met.unionByName(front, allowMissingColumns=True)
        if after:
            met = met.unionByName(ends.select(*key, F.lit(1).alias("__side"), *[F.last(f"__{n}", True).over(later).alias(f"__{n}") for n in after]), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__side", *order)
    seen, earlier, later = (w.rowsBetween(*x) for x in ((Window.unboundedPreceding, 0), before_it, (1, Window.unboundedFollowing)))
    found = {n: F.last(f"__{n}", True).over(seen) for n in upto or {}} | {n: F.last(f"__{n}", True).over(earlier) for n in before or {}} | {n: F.first(f"__{n}", True).over(later) for n in after or {}} | {n: F.sum(f"__{n}").over(seen) for n in total}
    return met.withColumns(found).where("__side = 0").drop("__block", "__side", *[f"__{n}" for n in found])
