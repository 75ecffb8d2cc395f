"""Streams: statistics as state, event time, the paged search, documents that come into a folder; and the index that takes changes."""

import json
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidora.operators import lexical, segments
from evidora.plans.engine import Engine
from evidora.sources import files, paged_issues, table_tracker
from evidora.streaming import ingest, statistics


def rows(df):
    return sorted(map(tuple, df.collect()))


# --- statistics --------------------------------------------------------------------------------------
def test_statistics_follow_every_change(spark, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(12)]
    landing, held = str(tmp_path / "in"), {}
    kept = statistics.TermStatistics(spark, str(tmp_path / "t"), buckets=3)
    for batch in range(3):
        new = [(rng.randint(0, 9), rng.randint(0, 4), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(12)] + [(50 + batch, 1, None)]
        for key, version in {(k, v) for k, v, _ in new}:
            assert version >= 0 and key >= 0
        new = list({(k, v): (k, v, t) for k, v, t in new}.values())
        for k, v, t in sorted(new, key=lambda r: r[1]):
            if k not in held or v > held[k][0]:
                held[k] = (v, t)
        spark.createDataFrame(new, "key int, version int, text string").coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema("key int, version int, text string").parquet(landing)
        kept.follow(source, "key", "version", str(tmp_path / "ckpt")).awaitTermination()  # a restart each time
    final = spark.createDataFrame([(k, t) for k, (_, t) in held.items()], "key int, text string")
    assert rows(kept.frequencies()) == rows(lexical.document_frequency(final))
    (n, mean), (m, want) = tuple(kept.size().first()), tuple(lexical.collection_size(final).first())
    assert n == m and mean == pytest.approx(want)


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    kept = statistics.TermStatistics(spark, str(tmp_path / "t"))
    changes = spark.createDataFrame([("a", 2, 0, 0), ("b", 1, 0, 0), ("", 0, 2, 3)], statistics.DELTAS)
    for batch in (0, 0, 1, 0):
        kept.add(changes, batch)
    assert rows(kept.frequencies()) == [("a", 4), ("b", 2)] and tuple(kept.size().first()) == (4, 1.5)
    empty = statistics.TermStatistics(spark, str(tmp_path / "none"))
    assert rows(empty.frequencies()) == [] and tuple(empty.size().first()) == (0, 1.0)


# --- the index ---------------------------------------------------------------------------------------
def index_equals(spark, index, held, asked):
    final = spark.createDataFrame(list(held.items()), "doc_id bigint, text string")
    assert rows(index.frequencies()) == rows(lexical.document_frequency(final))
    (n, mean), (m, want) = tuple(index.size().first()), tuple(lexical.collection_size(final).first())
    assert n == m and mean == pytest.approx(want)
    assert rows(index.top(asked, 6)) == rows(lexical.bm25_top(final, asked, 6))


@pytest.mark.parametrize("literals", [512, 1])
def test_index_takes_changes(spark, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(segments.SegmentIndex, "LITERALS", literals)
    rng = random.Random(7)
    words = [f"term{i}" for i in range(15)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 8)))
    asked = spark.createDataFrame([(1, "term1 term2 term2"), (2, "term7 unheard"), (3, "")], "qid int, question string")
    index, held = segments.SegmentIndex(spark, str(tmp_path / "i")), {}
    assert rows(index.top(asked, 6)) == []
    for step in range(4):
        fresh = {rng.randint(0, 25): text() for _ in range(9)}
        index.add(spark.createDataFrame(list(fresh.items()), "doc_id bigint, text string"))
        held |= fresh
        if step % 2:
            gone = [*rng.sample(sorted(held), 3), 999]
            index.delete(spark.createDataFrame([(g,) for g in gone], "doc_id bigint"))
            held = {k: t for k, t in held.items() if k not in gone}
        if step == 1:
            index_equals(spark, index, held, asked)
        if step >= 1:
            before = index.segments()
            assert index.merge() == (len(index.segments()) < len(before))
    index_equals(spark, index, held, asked)
    alone = index.segments()
    assert len(alone) < 6 and index.vacuum() > 0 and index.segments() == alone
    index_equals(spark, index, held, asked)


def test_unfinished_segments_are_not_read(spark, tmp_path):
    index = segments.SegmentIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame([(1, "alpha beta")], "doc_id bigint, text string"))
    (tmp_path / "i/2-2/postings").mkdir(parents=True)
    assert index.segments() == [(1, 1)]
    index.add(spark.createDataFrame([(1, "gamma")], "doc_id bigint, text string"))
    assert index.segments() == [(1, 1), (2, 2)] and rows(index.frequencies()) == [("gamma", 1)]


def test_a_search_of_few_terms_reads_few_postings(spark, tmp_path):
    spark.conf.set("parquet.block.size", 1 << 14)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 14))
    try:
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 20), i -> concat('t', (id * 31 + i * 97) % 5000)))").alias("text"))
        index = segments.SegmentIndex(spark, str(tmp_path / "i")).add(docs)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    asked = spark.createDataFrame([(1, "t17 t4000")], "qid int, question string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows its scans
    try:
        held = index.held(asked)
        found = held.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["term"] for r in found} == {"t17", "t4000"} and len(found) > 10
    assert 0 < segments.postings_read(held) < 0.2 * 4000 * 20


# --- event time --------------------------------------------------------------------------------------
EVENTS = "ts timestamp, event_type string, value double, user_id int"


def test_windows_of_a_stream_restart_and_drop_late_rows(spark, tmp_path):
    """Batches of (hour, n): a window closes two hours after its end; what comes later is dropped and counted as late."""
    landing, out, done = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    hour = lambda h, n: [(f"2024-01-01 {h:02d}:30:00", "x", 1.0, i) for i in range(n)]
    got, late = [], 0
    for batch in ([hour(1, 2), hour(2, 1)], [hour(9, 1), hour(1, 1)], [hour(10, 1)], [hour(1, 4), hour(9, 2)], [hour(20, 1)]):
        frame = spark.createDataFrame([r for part in batch for r in part], "ts string, event_type string, value double, user_id int")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema(EVENTS).parquet(landing)
        assert source.isStreaming
        query = ingest.append_windows(ingest.tumbling(source), out, done)  # a restart for each batch
        query.awaitTermination()
        late += sum(p["late"] for p in ingest.progress(query))
        got.append(spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(out).count())
    found = {r["start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert found == {1: 3, 2: 1, 9: 3, 10: 1} and got == sorted(got) and late > 0


# --- the paged search --------------------------------------------------------------------------------
class Growing:
    """Issues as a file says there are; every call is written down."""

    def __init__(self, options):
        self.folder = options["folder"]
        with open(f"{self.folder}/issues.json") as f:
            self.keys = json.load(f)

    def search(self, query, token, size):
        at = int(token or 0)
        more = at + size < len(self.keys)
        return {"issues": [{"key": k, "fields": {"summary": f"{query} {k}"}} for k in self.keys[at : at + size]], "isLast": not more} | ({"nextPageToken": str(at + size)} if more else {})

    def issue(self, key):
        return {"key": key, "fields": {}} if key in self.keys else None

    def comments(self, key):
        return [{"author": {"displayName": "Ann"}, "created": "2024-02-03T01:02", "body": f"about {key}"}]


def opened(tmp_path, n):
    (tmp_path / "issues.json").write_text(json.dumps([f"AB-{i}" for i in range(n)]))


def test_paged_batches(spark, tmp_path):
    paged_issues.register(spark)
    opened(tmp_path, 25)
    base = {"server": "tests.test_streams:Growing", "folder": str(tmp_path), "page": "4", "query": "open"}
    read = lambda **more: spark.read.format("paged_issues").options(**base, **more).load()
    assert sorted(r["key"] for r in read().collect()) == sorted(f"AB-{i}" for i in range(25))
    assert [r["key"] for r in read(max_results="6").collect()] == [f"AB-{i}" for i in range(6)] and read(max_results="0").count() == 0
    got = files.embedded_comments(read(max_results="1", comments="true")).first()
    assert (got["issue_key"], got["author"], got["body"]) == ("AB-0", "Ann", "about AB-0")
    assert read(key="AB-7").first()["key"] == "AB-7"
    with pytest.raises(Exception, match="no issue AB-99"):
        read(key="AB-99").collect()
    opened(tmp_path, 0)
    assert read().count() == 0


def test_paged_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    paged_issues.register(spark)
    seen = []
    for n in (0, 3, 3, 11, 24):
        opened(tmp_path, n)
        source = spark.readStream.format("paged_issues").options(server="tests.test_streams:Growing", folder=str(tmp_path), page="4").load()
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        seen = [r["key"] for r in spark.read.schema("key string, raw string").parquet(str(tmp_path / "out")).collect()] if n else []
        assert Counter(seen) == Counter(f"AB-{i}" for i in range(n))


def test_issues_of_a_search_are_added_with_their_chunks(spark, tmp_path):
    opened(tmp_path, 5)
    e = Engine(spark, str(tmp_path / "e"))
    options = {"server": "tests.test_streams:Growing", "folder": str(tmp_path), "query": "timeout"}
    assert [s["stage"] for s in e.add_found(options)] == ["searching", "fetched", "done"]
    assert e.records.count() == 5 and e.chunks.read().where("text LIKE '%about AB-3%'").count() > 0
    opened(tmp_path, 7)
    assert list(e.add_found(options | {"max_results": "6"}))[-1] == {"stage": "done", "records": 6, "new": 1}


def test_many_pages_are_few_tasks(tmp_path):
    opened(tmp_path, 1003)
    reader = paged_issues.IssueStreamReader({"server": "tests.test_streams:Growing", "folder": str(tmp_path), "page": "2"})
    start, end = {"token": "4", "read": 1}, reader.latestOffset()
    parts = reader.partitions(start, end)
    assert len(parts) <= paged_issues.TASKS and [k for p in parts for k, _ in reader.read(p)] == [f"AB-{i}" for i in range(5, 1003)]
    middle = {"token": "996", "read": 1}
    assert [k for a, z in ((start, middle), (middle, end)) for p in reader.partitions(a, z) for k, _ in reader.read(p)] == [f"AB-{i}" for i in range(5, 1003)]


def test_a_walk_through_the_tracker_decodes_each_row_group_once(tmp_path, monkeypatch):
    turns = [(k, t, "user", f"{k} says {t}") for k in range(300) for t in range(3)]
    turns = turns[:500] + turns[501:] + turns[500:501]  # a turn away from the others of its conversation
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns))))), tmp_path / "c.parquet", row_group_size=100)
    whole, load = [], table_tracker._Table._load
    monkeypatch.setattr(table_tracker._Table, "_load", lambda self, i: whole.append(i) or load(self, i))
    tracker = table_tracker.Tracker({"table": str(tmp_path / "c.parquet")})
    found = {i["key"]: [i["fields"]["summary"], *[c["body"] for c in tracker.comments(i["key"])]] for _, issues in paged_issues.pages(tracker, "", 7) for i in issues}
    assert found == {f"CNV-{k}": [f"{k} says {t}" for t in range(3)] for k in range(300)} and sorted(whole) == list(range(9))


class Held:
    """State of one group of keys, for a processor that runs outside a stream."""

    def __init__(self):
        self.kept = {}

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.kept[key] = value


def test_a_group_of_keys_is_one_call_and_one_row_a_term(spark):
    deltas, held = statistics.TermDeltas(), Held()
    deltas.init(held)
    first = pd.DataFrame({"key": [f"k{i}" for i in range(1000)], "version": 1, "terms": [f"all own{i}" for i in range(1000)]})
    (out,) = deltas.handleInputRows((0,), iter([first.head(300), first.tail(700)]), None)
    assert len(out) == 1002 and out.head(2).values.tolist() == [["", 0, 1000, 2000], ["all", 1000, 0, 0]] and len(held.kept) == 1000
    again = pd.DataFrame({"key": ["k1", "k1", "k1", "k2", "k3"], "version": [2, 3, 2, 1, 2], "terms": ["mid", "all", "mid", "stale", ""]})
    (out,) = deltas.handleInputRows((0,), iter([again]), None)
    assert out.values.tolist() == [["", 0, 0, -3], ["all", -1, 0, 0], ["own1", -1, 0, 0], ["own3", -1, 0, 0]]
    assert list(deltas.handleInputRows((0,), iter([again]), None)) == []
