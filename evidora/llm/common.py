"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries have no such call
    _trim = None

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is whatever ``spark.checkpoint.dir`` names. Where a session has none, it is one below the warehouse, which
    all executors share; only a local session, as in tests, gets a temporary one, which goes when Python ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="evidora-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_evidora_checkpoints")
    return df.checkpoint(eager=True)


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Plans made inside let go of their shuffle files when their action ends; for rounds that each end in ``materialize``."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over rows that hold whole texts: in batches of a few MB, of which JVM and worker both keep copies.

    Spark reads the bound when the plan runs, so it stays set in the session; a lower one of the caller's is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one holds about ``limit`` bytes; a longer single row stays whole."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if n == 0:
            continue
        step = max(1, min(n, int(n * limit / max(1, batch.nbytes))))
        while at < n:
            part = batch.slice(at, step)
            while part.num_rows > 1 and part.nbytes > 2 * limit:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
            give_back()


def give_back() -> None:
    """Return freed memory to the system, as a Python worker lives on beside the next tasks' workers and the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
