"""Incremental ingest with Structured Streaming: files in, upserted tables out; and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import KeyedTable


def upsert_stream(source: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is upserted; a batch that runs again after a failure gives the same table. One stream owns the table."""
    table.recover()
    return source.writeStream.foreachBatch(lambda batch, i: table.apply(batch, f"{i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's events with their watermark, which needs times of the session's zone; tables as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window; works on streams (late rows past the watermark drop) and tables."""
    source = timed(events, late)
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    source = timed(events, late)
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def append_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Windows as they close, each once: Parquet files in ``path``, of which readers see those of finished batches only.

    A window closes when the watermark passes its end; what comes later for it is dropped. The state holds open windows only, and a
    query that starts again goes on from the checkpoint.
    """
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Row counts of a query's micro-batches, and how many rows came too late for their windows."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "late": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])} for p in query.recentProgress]


def read_folder(spark: SparkSession, path: str, schema: str, files: int = 200) -> DataFrame:
    """A landing folder of JSON lines as a stream, at most ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
