"""From pages in Markdown to the chunks that questions are answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from . import documents, tables

CONDITIONS = ["user_feature_flag", "coexist_feature_flag", "energy_default_baseline", "eo_default_baseline"]
ROW = [*CONDITIONS, *tables.WIDGETS]


def elements_of(pages: DataFrame) -> DataFrame:
    """(source_file, page, ord, element_type, content, h1, h2) of (source_file, page, markdown)."""
    head = lambda marks: F.nullif(T.strip(F.regexp_extract("content", rf"(?m)^{marks} (.*)$", 1)), F.lit(""))
    found = documents.split_pages(pages).withColumn("h1_here", head("#")).withColumn("h2_here", head("##"))
    return documents.heading_fill(found, ["page", "ord"], blocks=False)


def chunks_of(elements: DataFrame) -> DataFrame:
    """All chunks of a document's elements, numbered within its file; without vectors.

    Texts by section; of every table, put together over pages, a chunk a row and one of the whole; of every part of a table as it stands
    on its page a fragment. Rows of widget matrices carry their conditions and widgets as columns.
    """
    sections = documents.merge_sections(elements, ["page", "ord"], blocks=False)
    text = documents.section_chunks(sections).select("source_file", F.lit("TEXT").alias("asset_type"), "chunk_type", "section", "page_info", "display", "embed_text", F.struct("island", "part", F.lit(0).alias("at")).alias("place"))

    parsed = tables.parse_table(sections.where((F.col("element_type") == "TABLE") & ~documents.is_screenshot_table(F.col("content"))), "content")
    fragments = parsed.select("source_file", "page", F.col("island").alias("frag"), "headers", "rows", "section", F.lit("").alias("cue"), F.col("content").alias("markdown"), classify.table_type(F.col("headers"), F.col("section")).alias("table_type"))
    chained = tables.chains(fragments)
    named = chained.groupBy("source_file", "chain").agg(F.min_by("section", F.struct("page", "frag")).alias("section"), F.min("frag").alias("frag"))
    whole = tables.whole_tables(chained).join(named, ["source_file", "chain"]).withColumn("page_info", F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end")))

    each = whole.select("source_file", "section", "page_info", "table_type", "group_id", "headers", "frag", F.posexplode("rows").alias("at", "cells"))
    each = each.withColumn("matrix", tables.matrix_row(F.col("headers"), F.col("cells"), F.col("at") + 1)).withColumn("flag", tables.flag_row(F.col("headers"), F.col("cells")))
    is_matrix = F.col("table_type") == "conditional_matrix"
    said = F.when(is_matrix, tables.matrix_row_text(F.col("matrix"))).when(F.col("table_type") == "feature_flags", tables.flag_row_text(F.col("flag"))).otherwise(tables.generic_row_text(F.col("headers"), F.col("cells")))
    rows = each.select("source_file", F.lit("TABLE_ROW").alias("asset_type"), F.lit("table_row").alias("chunk_type"), "section", "page_info", tables.row_sentence(F.col("headers"), F.col("cells")).alias("display"), said.alias("embed_text"), F.struct(F.col("frag").alias("island"), F.lit(0).alias("part"), "at").alias("place"), "table_type", "group_id", *[F.when(is_matrix, F.col(f"matrix.{c}")).otherwise("").alias(c) for c in ROW])

    about = tables.table_text(F.col("headers"), F.col("rows"), F.col("section"), F.col("page_start"), F.col("table_type"))
    full = whole.select("source_file", F.lit("TABLE_FULL").alias("asset_type"), F.lit("table_whole").alias("chunk_type"), "section", "page_info", tables.markdown_of(F.col("headers"), F.col("rows")).alias("display"), about.alias("embed_text"), F.struct(F.col("frag").alias("island"), F.lit(0).alias("part"), F.lit(0).alias("at")).alias("place"), "table_type", "group_id")
    groups = whole.select("source_file", "chain", "group_id")
    parts = chained.join(groups, ["source_file", "chain"]).select("source_file", F.lit("TABLE_FRAGMENT").alias("asset_type"), F.lit("table_fragment").alias("chunk_type"), "section", F.col("page").cast("string").alias("page_info"), F.col("markdown").alias("display"), F.left("markdown", F.lit(500)).alias("embed_text"), F.struct(F.col("frag").alias("island"), F.lit(1).alias("part"), F.lit(0).alias("at")).alias("place"), "table_type", "group_id")

    found = rows.unionByName(full, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True).unionByName(text, allowMissingColumns=True)
    found = found.fillna("", ["table_type", "group_id", *ROW]).withColumn("element_type", F.col("asset_type"))
    return documents.sequence_ids(found, ["place", "asset_type"], blocks=False).drop("place", "element_type")
