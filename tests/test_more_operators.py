import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidora.operators import conversations, retrieval, routes
from evidora.plans.engine import Engine
from evidora.sources import llm_output


@pytest.mark.parametrize(("text", "title"), [("", "New chat"), ("  a \n b ", "a b"), ("x" * 60, "x" * 48 + "…"), ("y" * 47 + " z", "y" * 47 + "…")])
def test_titles(spark, text, title):
    assert spark.createDataFrame([(text,)], "t string").select(conversations.derive_title(F.col("t")).alias("v")).first()["v"] == title


@pytest.mark.parametrize(("seconds", "said"), [(10, "just now"), (120, "2m ago"), (7200, "2h ago"), (3 * 86400, "3d ago"), (15 * 86400, "2w ago"), (90 * 86400, "Feb 2")])
def test_relative_time(spark, seconds, said):
    now = dt.datetime(2024, 5, 2, 12)
    row = spark.createDataFrame([(now - dt.timedelta(seconds=seconds), now)], "a timestamp, b timestamp")
    assert row.select(conversations.relative_time(F.col("a"), F.col("b")).alias("v")).first()["v"] == said


def test_changes(spark):
    c = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True), (4, "d", False)], "conv_id int, title string, pinned boolean")
    ops = spark.createDataFrame([(1, "rename", " new "), (2, "pin", None), (3, "unpin", None), (4, "delete", None)], "conv_id int, op string, title string")
    assert sorted(map(tuple, conversations.change(c, ops).collect())) == [(1, "new", False), (2, "b", True), (3, "c", False)]


def test_followups(spark):
    hits = spark.createDataFrame([(1, p, s) for p in range(5) for s in (0.7, 0.65 if p != 1 else 0.1)], "qid int, pos int, score double")
    got = routes.validated_followups(hits.select("qid", "pos").distinct(), hits).collect()
    assert sorted(r["pos"] for r in got) == [0, 2, 3]


def test_llm_output():
    assert llm_output.parse_object('```json\n{"a": 1}\n```') == {"a": 1} and llm_output.parse_object('x {"b": [2]} y') == {"b": [2]} and llm_output.parse_object("none") == {}
    assert llm_output.parse_list('sure: ["a", "b"]') == ["a", "b"] and llm_output.parse_list('"x" and "y"') == ["x", "y"]


def test_upload_rules():
    Engine.check_upload("a.PDF", 10)
    for name, size in (("a.txt", 10), ("a.pdf", 0), ("a.pdf", 21 << 20)):
        with pytest.raises(ValueError):
            Engine.check_upload(name, size)


def test_candidates_are_scored_without_a_row_for_every_word(spark):
    """40 questions that share a word with 300 chunks of 40 words: no shuffle takes a row for each word of each pair, or each chunk of a common word."""
    words = "concat_ws(' ', transform(sequence(1, 40), i -> concat('word', (id * i) % 997)))"
    chunks = spark.range(300).selectExpr("concat('c', id) AS chunk_id", "concat('EVD-', id) AS issue_key", "'problem_chunk' AS chunk_type", f"concat('commonestofall ', {words}) AS text", "0.5 AS quality_score", "false AS is_fixed", "false AS is_cancelled", "array('sync') AS components", "cast(null AS string) AS team")
    issues = chunks.selectExpr("issue_key", "text AS search_text")
    asked = spark.range(40).selectExpr("id AS qid", f"concat('commonestofall sync ', {words}) AS question")
    scored = retrieval.score_chunks(chunks, issues, asked).select("qid", "chunk_id", "sem", "kw", "meta", "score")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = scored.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["qid"] for r in got} == set(range(40)) and all(abs(r["meta"] - 1 / 3) < 1e-9 for r in got) and max(r["kw"] for r in got) == 1
    assert {r["qid"] for r in got if r["kw"] == 1 and r["chunk_id"] == f"c{r['qid']}"} >= set(range(1, 40))

    def most(plan):
        while plan.nodeName().startswith("AdaptiveSparkPlan") or "QueryStage" in plan.nodeName():
            plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan.plan()
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        return max([own, *[most(plan.children().apply(i)) for i in range(plan.children().size())]])

    assert most(scored._jdf.queryExecution().executedPlan()) <= 300 * 41
