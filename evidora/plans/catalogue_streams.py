"""Queries on streams: incremental upserts, and windows over events (an extension)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.segments import SegmentIndex
from ..operators.upsert import KeyedTable
from ..sources import paged_issues
from ..streaming import ingest, statistics
from . import catalogue_search
from . import duck as D
from . import views as V

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def shared_folder(spark) -> str:
    """A new folder that driver and executors share: under the cluster's checkpoint folder, else the warehouse; local sessions use a temporary one, which goes when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = tempfile.mkdtemp(prefix="evidora-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/evidora-{uuid.uuid4().hex}"


_OUT_OF_ORDER = "event_id % 3"


@query("stream_upsert_equals_batch", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upsert_equals_batch(spark, sf_dir):
    """Three micro-batches that don't come in order of their versions: the table ends with the newest of each key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    landing = shared_folder(spark)
    for part in (2, 0, 1):
        events.where(f"{_OUT_OF_ORDER} = {part}").coalesce(1).write.mode("append").parquet(landing)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    table = KeyedTable(spark, shared_folder(spark), "user_id bigint, event_id bigint, event_type string", ["user_id"], "event_id")
    ingest.upsert_stream(source, table, shared_folder(spark)).awaitTermination()
    return table.read()


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return ingest.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def session_windows(spark, sf_dir):
    return ingest.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("event_properties", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


#: Documents as a stream brings them: half of them first with other words, then as they are, some again, and some in a version that is older.
_VERSIONS = ["SELECT doc_id, 1 AS version, CASE WHEN doc_id % 2 = 0 THEN text || ' draftonly wording' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1",
             "SELECT doc_id, 2 AS version, text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 1",
             "SELECT doc_id, 2 AS version, text FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 0 AS version, 'staleonly words' AS text FROM documents WHERE doc_id % 7 = 0"]


@query("stream_term_statistics", f"""WITH tok AS (SELECT list_distinct({D.tokens("text")}) AS t FROM documents), size AS (SELECT count(*) AS n, round(avg(len(t))::DOUBLE, 6) AS avgdl FROM tok)
SELECT term, count(*) AS df, n, avgdl FROM (SELECT unnest(t) AS term FROM tok) x CROSS JOIN size GROUP BY ALL""")
def stream_term_statistics(spark, sf_dir):
    """Frequencies and sizes kept as state of a stream with changed, repeated and stale documents equal those of the final table."""
    V.register(spark, sf_dir, "documents")
    landing, checkpoint = shared_folder(spark), shared_folder(spark)
    kept = statistics.TermStatistics(spark, shared_folder(spark))
    for text in _VERSIONS:  # each comes as files of many tasks, and the stream goes on from its checkpoint with those as a batch
        spark.sql(text).write.mode("append").parquet(landing)
        source = spark.readStream.schema("doc_id bigint, version int, text string").parquet(landing)
        kept.follow(source, "doc_id", "version", checkpoint).awaitTermination()
    return kept.frequencies().crossJoin(F.broadcast(kept.size())).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


@query("index_updates", catalogue_search._bm25_sql(10))
def index_updates(spark, sf_dir):
    """An index built on other texts, then added to, replaced, deleted from and merged, answers like one of the final documents."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = SegmentIndex(spark, shared_folder(spark))
    index.add(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" publish mapping error asset sync"))).otherwise(F.col("text"))))
    index.add(docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 6 = 1").selectExpr("-1 - doc_id AS doc_id", "text")))
    index.add(docs.where("doc_id % 4 = 0"))
    index.delete(docs.selectExpr("-1 - doc_id AS doc_id"))
    index.merge()
    return index.top(V.view(spark, sf_dir, V.QUESTIONS), 10)


_LATE = "2 hours"
#: The batch in which an event arrives: five days at a time, a tenth of them one batch late and some three.
_ARRIVAL = "CAST(floor((day(ts) - 1) / 5) AS INT) + CASE WHEN event_id % 37 = 0 THEN 3 WHEN event_id % 10 = 0 THEN 1 ELSE 0 END"


@query("stream_windows", f"""WITH e AS (SELECT *, {_ARRIVAL} AS b, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events), m AS (SELECT b, max(max(ts)) OVER (ORDER BY b) - INTERVAL {_LATE} AS mark FROM e GROUP BY b),
 k AS (SELECT e.* FROM e LEFT JOIN m ON m.b = e.b - 2 WHERE m.mark IS NULL OR e.start + INTERVAL 1 HOUR > m.mark)
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM k WHERE start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM m) GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Events in order of arrival as a stream: windows that closed, without what came after the watermark. A batch's late rows are told by the mark that the batch before it ran with."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("arrives", F.expr(_ARRIVAL))
    last = events.agg(F.max("arrives")).first()[0]
    landing, out = shared_folder(spark), shared_folder(spark)
    for b in range((last if last is not None else -1) + 1):  # six batches of a month, three more for the late
        events.where(F.col("arrives") == b).drop("arrives").coalesce(1).write.mode("append").parquet(landing)
    source = spark.readStream.schema(events.drop("arrives").schema).option("maxFilesPerTrigger", 1).parquet(landing)
    ingest.append_windows(ingest.tumbling(source, late=_LATE), out, shared_folder(spark)).awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("paged_issue_stream", """WITH n AS (SELECT conv_id, arg_min(text, turn) AS summary, count(*) - 1 AS n_comments FROM conversations GROUP BY conv_id)
SELECT 'CNV-' || conv_id AS issue_key, summary, CAST(n_comments AS BIGINT) AS n_comments FROM n""")
def paged_issue_stream(spark, sf_dir):
    """A tracker's issues by pages as a stream that stops when a third of them are open and starts again when all are: none is lost or comes twice."""
    paged_issues.register(spark)
    out, checkpoint = shared_folder(spark), shared_folder(spark)
    total = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    for upto in (total // 3, total):
        source = spark.readStream.format("paged_issues").options(server="evidora.sources.table_tracker:Tracker", table=f"{sf_dir}/conversations.parquet", upto=upto, page=64, comments="true").load()
        source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    raw = spark.read.schema("key string, raw string").parquet(out)
    said = F.size(F.from_json(F.get_json_object("raw", "$.fields.comment.comments"), "array<struct<body:string>>"))
    return raw.select(F.col("key").alias("issue_key"), F.get_json_object("raw", "$.fields.summary").alias("summary"), said.cast("bigint").alias("n_comments"))
