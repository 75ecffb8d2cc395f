"""Context around hits: neighbours, sections, tables, and the route-aware cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_file", "sequence_id"]


def neighbours(chunks: DataFrame, hits: DataFrame, reach: int = 3) -> DataFrame:
    """Chunks within ``reach`` of a hit in the same file, hits left out. The range becomes an equi-join on exploded ids."""
    wanted = hits.select("source_file", F.explode(F.sequence(F.col("sequence_id") - reach, F.col("sequence_id") + reach)).alias("sequence_id")).distinct()
    return chunks.join(wanted, KEY, "left_semi").join(hits.select(*KEY), KEY, "left_anti")


def points(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks at the wanted (source_file, sequence_id), each once."""
    return chunks.join(wanted.select(*KEY).distinct(), KEY, "left_semi")


def span(chunks: DataFrame, hits: DataFrame, before: int = 5, after: int = 5, most: int = 50) -> DataFrame:
    """Text chunks from before the first to after the last hit of each file, the first ``most``."""
    ends = hits.groupBy("source_file").agg((F.min("sequence_id") - before).alias("__a"), (F.max("sequence_id") + after).alias("__z"))
    found = chunks.where("asset_type = 'TEXT'").join(ends, "source_file").where("sequence_id BETWEEN __a AND __z").drop("__a", "__z")
    ranked = found.withColumn("__r", F.row_number().over(Window.partitionBy("source_file").orderBy("sequence_id")))
    return ranked.where(F.col("__r") <= most).drop("__r").join(hits.select(*KEY), KEY, "left_anti")


def section_siblings(chunks: DataFrame, hits: DataFrame, most: int = 100) -> DataFrame:
    """Texts of the sections that hold a hit, up to ``most`` each, hits left out."""
    return _siblings(chunks.where("asset_type = 'TEXT'"), hits, ["source_file", "section"], most)


def table_siblings(chunks: DataFrame, hits: DataFrame, most: int = 300) -> DataFrame:
    """Rows of the tables that hold a hit, up to ``most`` each, hits left out."""
    return _siblings(chunks.where("asset_type = 'TABLE_ROW'"), hits.where("asset_type = 'TABLE_ROW'"), ["source_file", "section"], most)


def _siblings(chunks: DataFrame, hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    found = chunks.join(hits.select(*keys).distinct(), keys, "left_semi")
    ranked = found.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("sequence_id")))
    return ranked.where(F.col("__r") <= most).drop("__r").join(hits.select(*KEY), KEY, "left_anti")


def expand(chunks: DataFrame, hits: DataFrame, extras: DataFrame) -> DataFrame:
    """Hits and extras, each place once, hits first."""
    both = hits.select(*KEY, F.lit(0).alias("hit")).distinct().join(extras.select(*KEY).distinct(), KEY, "full_outer")
    return both.select(*KEY, F.coalesce("hit", F.lit(1)).alias("side")).join(chunks, KEY)


def full_first(hits: DataFrame, k: int) -> DataFrame:
    """Whole sections before parts, then by score: the first 3k of each query."""
    w = Window.partitionBy("qid").orderBy(F.when(F.col("chunk_type") == "section_full", 0).otherwise(1), F.desc("score"), *KEY)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3 * k)


def smart_cap(hits: DataFrame, k: int = 5, most: int = 50) -> DataFrame:
    """The slots of each route: (qid, route, asset_type, score, ...) cut by category, then by ``most``, in reading order.

    Texts keep at least six slots on text and hybrid routes; elsewhere tables go first and leave two at least.
    """
    kind = F.when(F.col("asset_type") == "TEXT", "text").when(F.col("asset_type") == "TABLE_FULL", "full").when(F.col("asset_type").isin("TABLE_ROW", "TABLE", "TABLE_FRAGMENT"), "rows").otherwise("other")
    df = hits.withColumn("__kind", kind)
    of = Window.partitionBy("qid")
    tables = F.sum(F.when(F.col("__kind").isin("rows", "full"), 1).otherwise(0)).over(of)
    place = F.row_number().over(Window.partitionBy("qid", "__kind").orderBy(F.desc("score"), *KEY))
    text = F.when(F.col("route") == "text_section", max(k, 6)).when(F.col("route") == "hybrid", max(k // 2, 6)).otherwise(F.greatest(F.lit(2), k - tables))
    rows = F.when(F.col("route") == "text_section", max(k - max(k, 6) + 2, 2)).when(F.col("route") == "hybrid", max(k - max(k // 2, 6), 2)).otherwise(1 << 30)
    full = F.when(F.col("route").isin("text_section", "hybrid"), 0).otherwise(1 << 30)
    slots = F.when(F.col("__kind") == "text", text).when(F.col("__kind") == "rows", rows).when(F.col("__kind") == "full", full).otherwise(0)
    df = df.withColumn("__place", place).withColumn("__slots", slots).where("__place <= __slots")
    first = F.when((F.col("route") == "text_section") & (F.col("__kind") == "text"), 0).when(F.col("__kind") == "rows", 1).when(F.col("__kind") == "full", 2).otherwise(3)
    df = df.withColumn("__r", F.row_number().over(of.orderBy(first, "__place"))).where(F.col("__r") <= most)
    return df.withColumn("reading_order", F.row_number().over(of.orderBy("sequence_id", "source_file"))).drop("__kind", "__place", "__slots", "__r")
