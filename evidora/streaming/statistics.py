"""Document frequencies as running state: what each version of an issue changes, not what the whole table holds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import tokens
from ..operators.upsert import KeyedTable

DELTAS = "term string, df bigint, n bigint, total bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys that the state is dealt to; a checkpoint stays with the number that it began with.
GROUPS = 1024


class TermDeltas(StatefulProcessor):
    """Keeps the version and the distinct terms of each key; a newer version gives +1 for terms that came and -1 for those that went.

    Term '' carries the number of documents and of their distinct terms. Rows of a version that isn't newer change nothing, so
    that a key that is added again counts once. State is one entry a key, in a map for each group of keys, so that Python is
    called for a group and not for every key; changes of a group's batch are added up.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "key string", "version bigint, terms string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df: Counter[str] = Counter()
        n = total = 0
        for batch in rows:
            for own, version, found in zip(batch["key"], batch["version"].tolist(), batch["terms"]):
                before = self._last.getValue((own,))
                if before is not None and version <= before[0]:
                    continue
                old, new = set(before[1].split(" ")) if before and before[1] else set(), set(found.split(" ")) if found else set()
                self._last.updateValue((own,), (version, found))
                df.update(new - old)
                df.subtract(old - new)
                n, total = n + (before is None), total + len(new) - len(old)
        terms = sorted(t for t, by in df.items() if by)
        if n or total or terms:
            yield pd.DataFrame({"term": ["", *terms], "df": [0, *(df[t] for t in terms)], "n": [n] + [0] * len(terms), "total": [total] + [0] * len(terms)})

    def close(self) -> None:
        pass


def deltas(source: DataFrame, key: str, version: str, text: str = "text") -> DataFrame:
    """(term, df, n, total) changes of a stream of (key, version, text). Texts are cut into terms, which hold no blanks, before they meet the state."""
    own = F.to_json(F.struct(F.col(key).alias("k")))  # a null key is one too
    terms = source.select(F.pmod(F.xxhash64(own), F.lit(GROUPS)).alias("group"), own.alias("key"), F.col(version).cast("bigint").alias("version"), F.array_join(F.array_distinct(tokens(F.col(text))), " ").alias("terms"))
    return terms.groupBy("group").transformWithStateInPandas(TermDeltas(), DELTAS, "Update", "None")


class TermStatistics:
    """(term, df) and (n, avgdl) of the documents that a stream has brought so far, kept by adding up changes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = KeyedTable(spark, path, f"{DELTAS}, batch bigint", ["term"], "batch", buckets=buckets)

    def add(self, changes: DataFrame, batch: int) -> None:
        """Add one batch's changes. A row remembers the batch it was last changed by, so that a batch that runs again adds nothing twice."""
        more = changes.groupBy("term").agg(*[F.sum(c).alias(f"more_{c}") for c in ("df", "n", "total")])
        sums = [(F.coalesce(c, F.lit(0)) + F.col(f"more_{c}")).alias(c) for c in ("df", "n", "total")]
        fresh = more.join(self.table.read(), "term", "left").where(F.col("batch").isNull() | (F.col("batch") < batch))
        self.table.apply(fresh.select("term", *sums, F.lit(batch).cast("bigint").alias("batch")), f"{batch}")

    def follow(self, source: DataFrame, key: str, version: str, checkpoint: str, text: str = "text") -> StreamingQuery:
        """Keep up with a stream of documents. State lives in RocksDB, so it may outgrow the executors' memory; a query keeps the setting it started with."""
        spark, name = source.sparkSession, "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name, None)
        self.table.recover()
        writer = deltas(source, key, version, text).writeStream.outputMode("update").foreachBatch(lambda rows, i: self.add(rows, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        try:
            spark.conf.set(name, STORE)
            return writer.start()
        finally:
            spark.conf.set(name, before) if before is not None else spark.conf.unset(name)

    def frequencies(self) -> DataFrame:
        return self.table.read().where("term <> '' AND df > 0").select("term", "df")

    def size(self) -> DataFrame:
        mean = F.sum("total") / F.sum("n")
        return self.table.read().where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(mean).alias("avgdl"))
