"""Keyed upserts over plain tables, in batch and from a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import point_id


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with ``rows`` put in place of its rows of the same keys. Both hold a key once; one join does it."""
    fresh = rows.select(*key, F.struct(*[c for c in table.columns if c not in key], F.lit(True).alias("__new")).alias("__r"))
    joined = table.join(fresh, key, "full_outer")
    return joined.select(*[F.col(c) if c in key else F.when(F.col("__r.__new"), F.col(f"__r.{c}")).otherwise(F.col(c)).alias(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def with_point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col("chunk_id")))


def scroll(table: DataFrame, order: str, limit: int, after=None) -> DataFrame:
    """One page of a table in order of a unique column, beyond the last value of the page before. The filter reaches the scan, and each task hands on ``limit`` rows."""
    rest = table if after is None else table.where(F.col(order) > F.lit(after))
    return rest.orderBy(order).limit(limit)


class KeyedTable:
    """A Parquet table partitioned by a hash bucket of its key, changed by dynamic partition overwrite.

    A change merges its rows with the buckets it touches and writes the result below ``_staged``; once that is complete it
    replaces those buckets. A writer that dies before leaves the table as it was, and one that dies after is finished by
    the next change, so that each counts wholly or not at all. There is one writer at a time: a second one is told and changes nothing.

    All rows of a key are replaced together. A key holds one row, or with ``many``, as an issue's chunks, several. Deleted keys stay as marks,
    which older versions of them can't undo. ``buckets`` is chosen with the data, for some 100 MB each.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], version: str | None = None, many: bool = False, buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.many, self.buckets = spark, path.rstrip("/"), key, version, many, buckets
        self.schema = schema
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _stored(self) -> DataFrame:
        fs, path = self._fs()
        schema = f"{self.schema}, gone boolean, bucket int"
        there = fs.globStatus(path(f"{self.path}/bucket=*"))
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().where("NOT gone").select(*self.columns)

    def count(self) -> int:
        return self.read().count()

    def apply(self, rows: DataFrame, name: str | None = None) -> None:
        """Put ``rows`` in place of all rows of their keys. With a version column the newest of each key counts, and newer rows of the table stay."""
        if self.version:
            newest = Window.partitionBy(*self.key).orderBy(F.desc(self.version))
            rows = rows.withColumn("__r", (F.rank() if self.many else F.row_number()).over(newest)).where("__r = 1").drop("__r")
        elif not self.many:
            rows = rows.dropDuplicates(self.key)
        self._change(rows.select(*self.columns, F.lit(False).alias("gone")), name)

    def delete(self, keys: DataFrame, name: str | None = None) -> None:
        """Without the rows of these keys; with a version column ``keys`` say up to which version."""
        marks = keys.select(*self.key, *([self.version] if self.version else [])).dropDuplicates(self.key).withColumn("gone", F.lit(True))
        self._change(self._stored().select(*self.columns, "gone").limit(0).unionByName(marks, allowMissingColumns=True), name)

    def _change(self, fresh: DataFrame, name: str | None) -> None:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/_staged"))
        lock = path(f"{self.path}/_staged/writer")
        try:
            fs.create(lock, False).close()
        except Exception as held:
            raise RuntimeError(f"another writer is changing {self.path}; if it died, recover() finishes what it began") from held
        try:
            self._finish()
            staged = f"{self.path}/_staged/change-{name or uuid.uuid4().hex}"
            fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).persist()
            try:
                touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # numbers below ``buckets``
                if touched:
                    old = self._stored().where(F.col("bucket").isin(touched))
                    if self.version:
                        newer = old.select(*self.key, F.col(self.version).alias("__v")).groupBy(*self.key).agg(F.max("__v").alias("__v"))
                        fresh = fresh.join(newer, self.key, "left").where(F.col("__v").isNull() | (F.col(self.version) >= F.col("__v"))).drop("__v")
                    kept = old.join(fresh.select(*self.key).distinct(), self.key, "left_anti")
                    kept.unionByName(fresh).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
                    self._finish()
            finally:
                fresh.unpersist()
        finally:
            fs.delete(lock, False)

    def _finish(self) -> None:
        """Put complete staged changes in place; doing that again after a failure gives the same table. Incomplete ones are left out."""
        fs, path = self._fs()
        for found in fs.listStatus(path(f"{self.path}/_staged")):
            change = f"{self.path}/_staged/{found.getPath().getName()}"
            if found.isDirectory() and fs.exists(path(f"{change}/_SUCCESS")):
                self.spark.read.parquet(change).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            if found.isDirectory():
                fs.delete(path(change), True)

    def recover(self) -> None:
        """After a writer died: finish what it staged and let others write."""
        fs, path = self._fs()
        if fs.exists(path(f"{self.path}/_staged")):
            self._finish()
            fs.delete(path(f"{self.path}/_staged/writer"), False)
