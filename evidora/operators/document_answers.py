"""Questions to document chunks: each route's retrieval, the context around it, the cap, and a check of what is said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, vocab
from . import context, documents, routes, vectors

KEY = routes.KEY
#: What a search may ask of a chunk, as bits below those of the conditions.
ROWS, FULL, MATRIX, FLAGS, BELOW = 1, 2, 4, 8, 4
TABLES = ("TABLE_ROW", "TABLE_FRAGMENT")


def ask(questions: DataFrame, question: Column, provider: vectors.EmbeddingProvider | None = None) -> DataFrame:
    """Adds route, conditions, missing conditions and vector of normalised questions."""
    return questions.withColumns({"route": classify.doc_route(question), "conditions": classify.conditions(question), "missing": classify.missing_conditions(question), "qvec": vectors.embed(question, provider)})


def _bits() -> Column:
    """What a chunk is and which conditions it meets."""
    is_row = F.col("asset_type") == "TABLE_ROW"
    marks = {ROWS: is_row, FULL: F.col("asset_type") == "TABLE_FULL", MATRIX: is_row & (F.col("table_type") == "conditional_matrix"), FLAGS: is_row & (F.col("table_type") == "feature_flags")}
    return sum((F.when(yes, bit).otherwise(0).cast("bigint") for bit, yes in marks.items()), F.shiftleft(routes.row_bits(vocab.REQUIRED_CONDITIONS), BELOW))


def route_hits(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, route, source_file, sequence_id, score) by one search for all questions and routes.

    A question turns into one or two demands on what a chunk is: matrix rows that meet its conditions; flag rows, and anything for questions that no flag
    row answers; whole tables and rows; or nothing. Tables of rows that were hit are completed; texts keep whole sections first, and texts and hybrids 3k.
    """
    pool = max(50, k + 30)
    demand = (
        F.when(F.col("route") == "widget_matrix", F.array(F.shiftleft(routes.stated_bits(F.col("conditions")), BELOW) + ROWS + MATRIX))
        .when(F.col("route") == "feature_flag_table", F.array(F.lit(ROWS + FLAGS).cast("bigint"), F.lit(0).cast("bigint")))
        .when(F.col("route") == "table_full", F.array(F.lit(FULL).cast("bigint"), F.lit(ROWS).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    )
    asked = questions.select(F.col("qid").alias("__q"), "route", "qvec", F.posexplode(demand).alias("turn", "qbits")).withColumn("qid", F.struct("__q", "turn").cast("string"))
    named = chunks.withColumn("item", F.concat_ws("||", *KEY))
    found = vectors.top_k(asked, named.select("item", "vec", _bits().alias("bits")), pool, digits=4, match=True)
    found = found.join(asked.select("qid", "__q", "route", "turn"), "qid").drop("qid").withColumnRenamed("__q", "qid").join(named.drop("vec"), "item")
    first = F.min("turn").over(Window.partitionBy("qid"))
    found = found.withColumn("__first", first).where((F.col("route") != "feature_flag_table") | (F.col("turn") == F.col("__first")))
    found = found.where((F.col("route") != "widget_matrix") | (F.col("rank") <= k))
    best = found.withColumn("__r", F.row_number().over(Window.partitionBy("qid", *KEY).orderBy(F.desc("score")))).where("__r = 1")
    whole = routes.complete_tables(chunks, best.where(~F.col("route").isin("widget_matrix", "text_section"))).join(questions.select("qid", "route"), "qid")
    kept = best.where(F.col("route").isin("widget_matrix", "text_section")).select("qid", *KEY, "score", "route").unionByName(whole.select("qid", *KEY, "score", "route"))
    kept = kept.join(chunks.select(*KEY, (F.col("chunk_type") == "section_full").alias("__full")), KEY)
    order = Window.partitionBy("qid").orderBy(F.when(F.col("route") == "text_section", (~F.col("__full")).cast("int")).otherwise(0), F.desc("score"), *KEY)
    return kept.withColumn("__r", F.row_number().over(order)).where(~F.col("route").isin("text_section", "hybrid") | (F.col("__r") <= 3 * k)).select("qid", "route", *KEY, "score")


def expand(chunks: DataFrame, hits: DataFrame, reach: int = 3, around: int = 5, rows: int = 500, texts: int = 50, siblings: int = 100) -> DataFrame:
    """The hits and, with score 0, what stands around them, each place of a question once.

    Around rows and fragments of tables: places next to them, the rows of their tables and the whole tables. On the text route also the texts from
    before the first to after the last hit of a file, and the rest of their sections. All questions go through the same joins.
    """
    facts = chunks.select(*KEY, "asset_type", "group_id", "section")
    met = hits.join(facts, KEY)
    table = met.where(F.col("asset_type").isin(*TABLES) & (F.col("route") != "widget_matrix"))
    near = table.select("qid", "source_file", F.explode(F.sequence(F.col("sequence_id") - reach, F.col("sequence_id") + reach)).alias("sequence_id")).distinct().join(facts.select(*KEY), KEY)
    first = lambda found, by, most: found.withColumn("__r", F.row_number().over(Window.partitionBy("qid", *by).orderBy("source_file", "sequence_id"))).where(F.col("__r") <= most)
    groups = facts.where("group_id <> '' AND asset_type IN ('TABLE_ROW', 'TABLE_FULL')").join(table.where("group_id <> ''").select("qid", "group_id").distinct(), "group_id")
    grouped = first(groups, ["group_id", "asset_type"], rows)
    text = met.where("asset_type = 'TEXT' AND route = 'text_section'")
    ends = text.groupBy("qid", "source_file").agg((F.min("sequence_id") - around).alias("__a"), (F.max("sequence_id") + around).alias("__z"))
    plain = facts.where("asset_type = 'TEXT'")
    between = first(plain.join(ends, "source_file").where("sequence_id BETWEEN __a AND __z"), ["source_file"], texts)
    named = text.select("qid", "source_file", "section").unionByName(between.select("qid", "source_file", "section")).where("section <> ''").distinct()
    same = first(plain.join(named, ["source_file", "section"]), ["source_file", "section"], siblings)
    extras = reduce(DataFrame.unionByName, [x.select("qid", *KEY) for x in (near, grouped, between, same)]).distinct()
    both = hits.select("qid", *KEY, "score").join(extras.withColumn("__extra", F.lit(1)), ["qid", *KEY], "full_outer")
    return both.select("qid", *KEY, F.coalesce("score", F.lit(0.0)).alias("score")).join(hits.select("qid", "route").distinct(), "qid")


def evidence(chunks: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, route, score, reading_order, chunk columns) of ``route_hits``: with their context, without contents pages, after the cap.

    The hits go into several joins, so they should be persisted.
    """
    found = expand(chunks, hits).join(chunks.drop("vec"), KEY)
    return context.smart_cap(documents.drop_toc_chunks(found, "display"), k)


def exact_rows(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Of each widget question with conditions the first matrix row of its evidence that meets them all."""
    asked = questions.where("route = 'widget_matrix'").select("qid", routes.stated_bits(F.col("conditions")).alias("__need")).where("__need > 0")
    rows = found.where("table_type = 'conditional_matrix' AND asset_type = 'TABLE_ROW'").join(asked, "qid").where(routes.row_bits(vocab.REQUIRED_CONDITIONS).bitwiseAND(F.col("__need")) == F.col("__need"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *KEY))).where("__r = 1").drop("__r", "__need")


def unsaid(found: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, missing, display): widget values of the exact row that the answer (qid, answer) doesn't hold; only questions of which some are missing."""
    exact = exact_rows(found, questions)
    said = answers.join(exact.select("qid", *KEY), "qid")
    return routes.value_mismatches(exact.drop("qid", "route", "score"), said).where(F.size("missing") > 0).join(exact.select("qid", "display"), "qid")
