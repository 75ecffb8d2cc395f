"""Term statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import tokens


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): documents that hold a term."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def collection_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl): documents, and their mean number of distinct terms (1 if that is zero)."""
    mean = F.avg(F.size(F.array_distinct(tokens(F.col(text)))))
    return docs.agg(F.count("*").alias("n"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mean).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, weight: Column, dl: Column, avgdl: Column) -> Column:
    return F.when(tf > 0, weight * tf * (vocab.K1 + 1) / (tf + vocab.K1 * (1 - vocab.B + vocab.B * dl / avgdl))).otherwise(F.lit(0.0))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl): an inverted index, to be written sorted by term."""
    split = docs.select(key, tokens(F.col(text)).alias("t"))
    return split.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, key, score, rank): the k best documents of each query by BM25 over the inverted index.

    An equi-join on the term meets the index only where a query has a term; repeated query terms count again.
    """
    return ranked(postings(docs, key, text), document_frequency(docs, text), collection_size(docs, text), queries, k, key)


def ranked(held: DataFrame, frequencies: DataFrame, size: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    asked = queries.select("qid", F.explode(tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    found = held.join(asked, "term").join(frequencies, "term").crossJoin(F.broadcast(size))  # one row
    scored = found.groupBy("qid", key).agg(F.round(F.sum(F.col("times") * bm25_term(F.col("tf"), idf(F.col("n"), F.col("df")), F.col("dl"), F.col("avgdl"))), 4).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


class StoredIndex:
    """Postings, document frequencies and sizes in a folder: counted once, read at every search.

    Postings are sorted by term within files, so that a search for a few terms skips most of them by the files' statistics.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> StoredIndex:
        rows = postings(docs, key, text)
        rows.repartitionByRange("term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{self.path}/postings")
        stored = self.spark.read.parquet(f"{self.path}/postings")
        stored.groupBy("term").agg(F.count("*").alias("df")).sort("term").write.mode("overwrite").parquet(f"{self.path}/frequencies")
        collection_size(docs, text).write.mode("overwrite").parquet(f"{self.path}/size")
        return self

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def top(self, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
        """(qid, key, score, rank), as ``bm25_top`` has it, from what is stored."""
        return ranked(self._read("postings"), self._read("frequencies"), self._read("size"), queries, k, key)


def updated_frequency(df: DataFrame, added: DataFrame, text: str = "text") -> DataFrame:
    """Document frequencies after adding documents: the sum of two small tables."""
    more = document_frequency(added, text).withColumnRenamed("df", "more")
    return df.join(more, "term", "full_outer").select("term", (F.coalesce("df", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("df"))
