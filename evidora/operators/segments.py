"""An inverted index that takes additions, replacements and deletions: immutable segments, merged by size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import lexical


class SegmentIndex:
    """Every change writes one segment and touches no other.

    A segment has the postings of its documents (key, term, tf, dl; sorted by term, so that files' statistics lead a search past most of them), the
    documents with their distinct terms (sorted by key), marks of the keys whose older versions it replaces or deletes, and counters by
    term: by how much the documents that hold the term became more (term '' counts documents and their distinct terms). Document frequencies and the mean length are sums of counters.
    Counters are written last; a segment without them was never finished and isn't read.

    ``merge`` joins neighbouring segments of like size, so that their number grows with the logarithm of the documents; a merged segment
    is named by the range it stands for, and those inside the range count no more.
    """

    #: Neighbours that are merged at a time, and by what factor sizes of one tier differ.
    FAN = 4
    #: Distinct query terms up to which they go to the scans as values; beyond it the postings meet them by a join only. Results are equal.
    LITERALS = 512

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint"):
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind

    # --- what there is ------------------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _complete(self) -> list[tuple[int, int]]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(tuple(map(int, n.split("-"))) for n in names if fs.exists(path(f"{self.path}/{n}/counters/_SUCCESS")))

    def segments(self) -> list[tuple[int, int]]:
        """(first, last) change of every segment that counts."""
        found = self._complete()
        return [s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found)]

    _SCHEMAS = {"postings": "{key} {kind}, term string, tf bigint, dl int", "docs": "{key} {kind}, terms array<string>", "marks": "{key} {kind}", "counters": "term string, df bigint, total bigint"}

    def _part(self, part: str, of: list[tuple[int, int]] | None = None) -> DataFrame:
        """One part of all segments, each row with the last change (``seq``) of its segment."""
        schema = self._SCHEMAS[part].format(key=self.key, kind=self.kind)
        found = [self.spark.read.schema(schema).parquet(f"{self.path}/{a}-{z}/{part}").withColumn("seq", F.lit(z)) for a, z in (self.segments() if of is None else of)]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{schema}, seq int")

    def _alive(self, rows: DataFrame, of: list[tuple[int, int]] | None = None) -> DataFrame:
        """Without rows whose key a later segment marks."""
        last = self._part("marks", of).groupBy(self.key).agg(F.max("seq").alias("__end"))
        return rows.join(last, self.key, "left").where(F.col("__end").isNull() | (F.col("__end") <= F.col("seq"))).drop("__end")

    # --- changes ------------------------------------------------------------------------------------
    def add(self, docs: DataFrame, text: str = "text") -> SegmentIndex:
        """Documents new or in place of those of their keys; of repeated keys one counts."""
        return self._write(docs.dropDuplicates([self.key]).select(self.key, tokens(F.col(text)).alias("t")), None)

    def delete(self, keys: DataFrame) -> SegmentIndex:
        return self._write(None, keys.select(self.key).distinct())

    def _write(self, fresh: DataFrame | None, gone: DataFrame | None) -> SegmentIndex:
        before = self.segments()
        n = max((z for _, z in before), default=0) + 1
        folder = f"{self.path}/{n}-{n}"
        if fresh is None:
            fresh = self.spark.createDataFrame([], f"{self.key} {self.kind}, t array<string>")
        docs = fresh.select(self.key, F.array_distinct("t").alias("terms"))
        postings = fresh.select(self.key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(self.key, "dl", "term").agg(F.count("*").alias("tf"))
        keys = docs.select(self.key) if gone is None else gone
        replaced = self._alive(self._part("docs", before), before).join(keys, self.key, "left_semi")
        docs.sort(self.key).write.mode("overwrite").parquet(f"{folder}/docs")
        replaced.select(self.key).sort(self.key).write.mode("overwrite").parquet(f"{folder}/marks")
        self._write_postings(postings, folder)
        came, went = self.spark.read.parquet(f"{folder}/docs").select("terms", F.lit(1).alias("by")), replaced.select("terms", F.lit(-1).alias("by"))
        both = came.unionByName(went)
        terms = both.select(F.explode("terms").alias("term"), "by").groupBy("term").agg(F.sum("by").alias("df"), F.lit(0).cast("bigint").alias("total"))
        sizes = both.agg(F.sum("by").alias("df"), F.sum(F.col("by") * F.size("terms")).alias("total")).select(F.lit("").alias("term"), F.coalesce("df", F.lit(0)).cast("bigint").alias("df"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
        terms.where("df <> 0").unionByName(sizes).sort("term").write.mode("overwrite").parquet(f"{folder}/counters")
        return self

    def _write_postings(self, postings: DataFrame, folder: str) -> None:
        postings.select(self.key, "term", "tf", "dl").repartitionByRange("term").sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{folder}/postings")

    def merge(self) -> bool:
        """Join the newest run of ``FAN`` or more neighbours that are no larger than the smallest tier among them allows; whether there was one."""
        now = self.segments()
        sizes = {r["seq"]: r["n"] for r in self._part("docs", now).groupBy("seq").agg(F.count("*").alias("n")).collect()}  # one number a segment
        tiers = [max(0, (sizes.get(z, 0) or 1).bit_length() - 1) // 2 for _, z in now]  # powers of four
        for tier in sorted(set(tiers)):
            run = []
            for segment, own in zip(reversed(now), reversed(tiers)):
                if own > tier:
                    break
                run.append(segment)
            if len(run) >= self.FAN:
                self._join(sorted(run), oldest=now[0])
                return True
        return False

    def _join(self, run: list[tuple[int, int]], oldest: tuple[int, int]) -> None:
        folder = f"{self.path}/{run[0][0]}-{run[-1][1]}"
        self._alive(self._part("docs", run), run).select(self.key, "terms").sort(self.key).write.mode("overwrite").parquet(f"{folder}/docs")
        marks = self._part("marks", run).select(self.key).distinct()
        (marks.limit(0) if run[0] == oldest else marks).sort(self.key).write.mode("overwrite").parquet(f"{folder}/marks")  # nothing older is left to mark
        self._write_postings(self._alive(self._part("postings", run), run), folder)
        counted = self._part("counters", run).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        counted.where("df <> 0 OR term = ''").sort("term").write.mode("overwrite").parquet(f"{folder}/counters")

    def vacuum(self) -> int:
        """Delete segments that merged ones stand for; how many. Not while a search that began before the merge still runs."""
        fs, path = self._fs()
        gone = [s for s in self._complete() if s not in self.segments()]
        for a, z in gone:
            fs.delete(path(f"{self.path}/{a}-{z}"), True)
        return len(gone)

    # --- reads --------------------------------------------------------------------------------------
    def frequencies(self) -> DataFrame:
        """(term, df), from counters alone."""
        return self._part("counters").where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def size(self) -> DataFrame:
        """One row (n, avgdl), as ``lexical.collection_size`` has it, from counters alone."""
        mean = F.sum("total") / F.sum("df")
        return self._part("counters").where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mean).alias("avgdl"))

    def held(self, queries: DataFrame) -> DataFrame:
        """Live postings of the terms that occur in the queries. Few terms reach the scans as values."""
        asked = queries.select(F.explode(tokens(F.col("question"))).alias("term")).distinct()
        some = [r["term"] for r in asked.limit(self.LITERALS + 1).collect()]
        found = self._part("postings")
        return self._alive(found.where(F.col("term").isin(some)) if len(some) <= self.LITERALS else found.join(asked, "term", "left_semi")).drop("seq")

    def top(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, key, score, rank), as ``lexical.bm25_top`` has it over the documents that are in the index now."""
        return lexical.ranked(self.held(queries), self.frequencies(), self.size(), queries, k, self.key)


def postings_read(df: DataFrame) -> int:
    """Rows that the scans of postings in an executed plan handed on: what the files' statistics didn't skip."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName().startswith("Scan parquet") and "tf" in list(leaf.schema().fieldNames()):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


