"""Hybrid search: the nearest vectors, BM25 over just these, and both orders fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical, vectors


def local_bm25(found: DataFrame, questions: DataFrame) -> DataFrame:
    """``found`` (qid, item, text, ...) with ``bm25``: each query's candidates are the collection that its terms are counted in.

    Terms are words of any script; those a question repeats count again. Candidates meet their own query's terms only.
    """
    sized = found.withColumn("__w", T.words(F.col("text"))).withColumn("__dl", F.size("__w"))
    of_query = sized.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avgdl"))
    asked = questions.select("qid", F.explode(T.words(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    held = sized.select("qid", "item", "__dl", F.explode("__w").alias("term")).join(asked, ["qid", "term"]).groupBy("qid", "term", "item", "__dl", "times").agg(F.count(F.lit(1)).alias("tf"))
    met = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("qid", "term"))).join(of_query, "qid")
    score = F.col("times") * lexical.bm25_term(F.col("tf"), lexical.idf(F.col("n"), F.col("df")), F.col("__dl"), F.col("avgdl"))
    scored = met.groupBy("qid", "item").agg(F.round(F.sum(score), 6).alias("bm25"))
    return found.join(scored, ["qid", "item"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def hybrid_search(items: DataFrame, questions: DataFrame, k: int = 10, source_file: str | None = None, asset_types: list[str] | None = None) -> DataFrame:
    """(qid, item, dense_rank, bm25_rank, rrf, rank): the k best of each question's max(5 k, 50) nearest items.

    ``items`` (item, vec, text) may have source_file and asset_type to filter by; ``questions`` are (qid, qvec, question). Equal
    scores keep the order of the vectors, and that of the items.
    """
    kept = items
    if source_file:
        kept = kept.where(F.col("source_file") == source_file)
    if asset_types:
        kept = kept.where(F.col("asset_type").isin(asset_types))
    near = vectors.top_k(questions.select("qid", "qvec"), kept.select("item", "vec"), max(5 * k, 50)).select("qid", "item", F.col("rank").alias("dense_rank"))
    found = local_bm25(near.join(kept.select("item", "text"), "item"), questions)
    by_query = Window.partitionBy("qid")
    fused = vectors.reciprocal_rank_fusion(found.withColumn("bm25_rank", F.row_number().over(by_query.orderBy(F.desc("bm25"), "dense_rank"))))
    ranked = fused.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("rrf"), "dense_rank")))
    return ranked.where(F.col("rank") <= k).select("qid", "item", "dense_rank", "bm25_rank", "rrf", "rank")
