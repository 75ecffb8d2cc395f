"""Stored tables and indexes, streams, and what SQL doesn't show of searches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evidora.operators import answers, context, hybrid, lexical, upsert, vectors
from evidora.streaming import ingest

KV = "k int, v int, t string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(spark, path, key=("k",), version="v", **kw):
    return upsert.KeyedTable(spark, str(path), KV, list(key), version, **kw)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.apply(spark.createDataFrame([(i, 1, "a") for i in range(500)], KV))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/bucket=*/*.parquet")}
    before = files()
    t.apply(spark.createDataFrame([(7, 2, "b")], KV))
    after = files()
    assert len(before) == t.buckets == len(after) and len(set(before) - set(after)) == 1 and all(after[f] == n for f, n in before.items() if f in after)
    assert t.count() == 500 and rows(t.read().where("k = 7")) == [(7, 2, "b")]


def test_older_versions_do_not_replace_newer_ones(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for batch in ([(1, 5, "new"), (2, 1, "x")], [(1, 3, "old"), (2, 2, "y"), (3, 9, "z")], [(1, 5, "again")], []):
        t.apply(spark.createDataFrame(batch, KV))
    assert rows(t.read()) == [(1, 5, "again"), (2, 2, "y"), (3, 9, "z")]


def test_deleted_keys_stay_deleted(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=2)
    t.delete(spark.createDataFrame([(9, 1)], "k int, v int"))
    t.apply(spark.createDataFrame([(i, 5, "a") for i in range(6)], KV))
    t.delete(spark.createDataFrame([(i, 6) for i in range(5)] + [(5, 4)], "k int, v int"))
    t.apply(spark.createDataFrame([(0, 5, "late"), (1, 7, "back")], KV))
    assert rows(t.read()) == [(1, 7, "back"), (5, 5, "a")]
    plain = upsert.KeyedTable(spark, str(tmp_path / "p"), KV, ["k"])
    plain.apply(spark.createDataFrame([(1, 1, "a")], KV))
    plain.delete(spark.createDataFrame([(1,), (1,)], "k int"))
    assert plain.count() == 0


def test_a_key_with_many_rows_is_replaced_whole(spark, tmp_path):
    t = upsert.KeyedTable(spark, str(tmp_path / "t"), KV, ["k"], many=True)
    t.apply(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], KV))
    t.apply(spark.createDataFrame([(1, 9, "z")], KV))
    assert rows(t.read()) == [(1, 9, "z"), (2, 1, "c")]


def test_a_second_writer_is_told_and_nothing_is_lost(spark, tmp_path):
    first, second = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    first.apply(spark.createDataFrame([(1, 1, "a")], KV))
    told = []

    class Meeting(upsert.KeyedTable):
        def _finish(self):
            if not told:
                with pytest.raises(RuntimeError, match="another writer"):
                    second.apply(spark.createDataFrame([(3, 1, "c")], KV))
                told.append(1)
            super()._finish()

    Meeting(spark, str(tmp_path / "t"), KV, ["k"], "v").apply(spark.createDataFrame([(2, 1, "b")], KV))
    second.apply(spark.createDataFrame([(3, 1, "c")], KV))
    assert told and rows(second.read()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]


def test_a_writer_that_dies_is_finished_or_left_out(spark, tmp_path):
    class Dying(upsert.KeyedTable):
        calls = 0

        def _finish(self):
            self.calls += 1
            if self.calls == self.dies_at:
                raise KeyboardInterrupt
            super()._finish()

    t = table(spark, tmp_path / "t")
    t.apply(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], KV))
    dying = Dying(spark, str(tmp_path / "t"), KV, ["k"], "v")
    dying.dies_at = 2  # after the change is staged
    with pytest.raises(KeyboardInterrupt):
        dying.apply(spark.createDataFrame([(1, 2, "b")], KV))
    assert rows(t.read()) == [(1, 1, "a"), (2, 1, "a")]
    (tmp_path / "t/_staged/change-half/bucket=0").mkdir(parents=True)  # one that never got complete
    (tmp_path / "t/_staged/writer").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        t.apply(spark.createDataFrame([(3, 1, "c")], KV))
    t.recover()
    t.apply(spark.createDataFrame([(3, 1, "c")], KV))
    assert rows(t.read()) == [(1, 2, "b"), (2, 1, "a"), (3, 1, "c")] and os.listdir(tmp_path / "t/_staged") == []


def test_an_upsert_stream_goes_on_after_it_died(spark, tmp_path):
    class Dying(upsert.KeyedTable):
        def apply(self, batch, name=None):
            super().apply(batch, name)
            if name == "1":
                raise ValueError("died after the batch was stored")

    landing, done = str(tmp_path / "in"), str(tmp_path / "ckpt")
    for n, batch in enumerate(([(1, 1, "a"), (2, 1, "a")], [(1, 3, "b")], [(2, 2, "c"), (1, 2, "late")])):
        spark.createDataFrame(batch, KV).coalesce(1).write.mode("append").parquet(landing)
    source = lambda: spark.readStream.schema(KV).option("maxFilesPerTrigger", 1).parquet(landing)
    with pytest.raises(Exception, match="died after"):
        ingest.upsert_stream(source(), Dying(spark, str(tmp_path / "t"), KV, ["k"], "v"), done).awaitTermination()
    t = table(spark, tmp_path / "t")
    assert rows(t.read()) == [(1, 3, "b"), (2, 1, "a")]
    ingest.upsert_stream(source(), t, done).awaitTermination()
    assert rows(t.read()) == [(1, 3, "b"), (2, 2, "c")]


def test_scroll_reads_every_row_once(spark):
    table, seen, after = spark.range(1, 58).toDF("id"), [], None
    while page := [r["id"] for r in upsert.scroll(table, "id", 10, after).collect()]:
        seen, after = seen + page, page[-1]
    assert seen == list(range(1, 58))


def test_blocks_of_items_give_the_same_hits(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(300)], "item int, vec array<double>")
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(5)], "qid int, qvec array<double>")
    want = rows(vectors.top_k(asked, items, 4).select("qid", "item", "score", "rank"))
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 7)
    assert rows(vectors.top_k(asked, items, 4).select("qid", "item", "score", "rank")) == want


def test_stored_index_equals_counting(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} gamma{i % 3} alpha") for i in range(60)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "alpha beta2 beta2"), (2, "gamma1 nothing"), (3, "")], "qid int, question string")
    index = lexical.StoredIndex(spark, str(tmp_path / "i")).build(docs)
    assert rows(index.top(asked, 7)) == rows(lexical.bm25_top(docs, asked, 7))


def test_local_bm25_by_hand(spark):
    import math

    found = spark.createDataFrame([(1, 10, "Red fox. Red!"), (1, 11, "blue fox"), (1, 12, ""), (2, 10, "Red fox. Red!")], "qid int, item int, text string")
    asked = spark.createDataFrame([(1, "red red fox"), (2, "é")], "qid int, question string")
    got = {(r["qid"], r["item"]): r["bm25"] for r in hybrid.local_bm25(found, asked).collect()}

    def term(tf, df, dl, n=3, mean=5 / 3):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))

    assert got[1, 10] == pytest.approx(2 * term(2, 1, 3) + term(1, 2, 3), abs=1e-6)
    assert got[1, 11] == pytest.approx(term(1, 2, 2), abs=1e-6) and got[1, 12] == 0 and got[2, 10] == 0


def test_small_pieces(spark):
    one = spark.createDataFrame([("a", "b")], "d string, t string")
    assert one.select(answers.fused_answer(F.col("d"), F.lit(""))).first()[0] == "a"
    assert one.select(answers.document_question(F.lit(" x "), lambda c: F.lit(" "))).first()[0] == "x"
    assert one.select(answers.document_question(F.lit("x"), lambda c: F.concat(F.lit("How does "), c, F.lit(" work?")))).first()[0] == "How does x work?"
    chunks = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "source_file string, sequence_id int")
    assert rows(context.points(chunks, spark.createDataFrame([("f", 2), ("f", 2), ("h", 1)], chunks.schema))) == [("f", 2)]
