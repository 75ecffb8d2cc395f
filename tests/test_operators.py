import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidora.operators import answers, context, documents, lexical, routes, tables, upsert, vectors
from evidora.plans import views as V
from evidora.plans.engine import Engine
from evidora.sources import files
from tests.oracle import check


def test_bm25_term(spark):
    r = spark.range(1).select(lexical.idf(F.lit(10), F.lit(3)).alias("i"), lexical.bm25_term(F.lit(2), lexical.idf(F.lit(10), F.lit(3)), F.lit(20), F.lit(25.0)).alias("b")).first()
    assert (round(r["i"], 6), round(r["b"], 6)) == (1.145132, 1.748294)


def test_rrf(spark):
    r = vectors.reciprocal_rank_fusion(spark.createDataFrame([(1, 3), (1, 1)], "dense_rank int, bm25_rank int")).collect()
    assert [x["rrf"] for x in r] == [0.032266, 0.032787]


def _pair(spark, gap, headers=("a", "b")):
    row = spark.createDataFrame([("f", 1, ["a", "b"], "", "generic_table", "f", 1 + gap, list(headers), "", "generic_table")], "s1 string, p1 int, h1 array<string>, c1 string, t1 string, s2 string, p2 int, h2 array<string>, c2 string, t2 string")
    st = lambda n: F.struct(F.col(f"s{n}").alias("source_file"), F.col(f"p{n}").alias("page"), F.col(f"h{n}").alias("headers"), F.col(f"c{n}").alias("cue"), F.col(f"t{n}").alias("table_type"))
    c, _ = tables.continuation(F.col("a"), F.col("b"))
    return round(row.select(st(1).alias("a"), st(2).alias("b")).select(c.alias("c")).first()["c"], 4)


def test_continuation(spark):
    assert [_pair(spark, g) for g in (1, 0, 2)] == [1.0, 0.7647, 0.4118]


@pytest.mark.parametrize(("a", "b", "j"), [(["a", "b"], ["b", "c"], 1 / 3), ([], [], 1.0), ([], ["a"], 0.0)])
def test_header_likeness(spark, a, b, j):
    r = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(tables.header_likeness(F.col("a"), F.col("b")).alias("j")).first()
    assert abs(r["j"] - j) < 1e-9


def test_parse_table(spark):
    md = "| A | B |\n\n|---|---|\n| 1 | 2 | 3 |\n| x |"
    r = tables.parse_table(spark.createDataFrame([(md,)], "m string"), "m").first()
    assert r["headers"] == ["a", "b"] and r["rows"] == [["1", "2"], ["x", ""]]


def test_splitter_keeps_everything():
    text = "\n\n".join("sentence number %d is here. " % i * 20 for i in range(30))
    parts = documents.split_recursively(text)
    assert all(len(p) <= 1200 for p in parts) and all(w in " ".join(parts) for w in text.split())


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = upsert.upsert(t, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, upsert.upsert(once, new, ["k"]).collect()))


def test_smart_cap_reading_order(spark):
    rows = [(1, "hybrid", "f", i, "TEXT" if i % 2 else "TABLE_ROW", float(i)) for i in range(40)]
    r = context.smart_cap(spark.createDataFrame(rows, "qid int, route string, source_file string, sequence_id int, asset_type string, score double")).orderBy("reading_order").collect()
    assert len(r) == 8 and [x["sequence_id"] for x in r] == sorted(x["sequence_id"] for x in r)


def test_neighbours_are_per_file(spark):
    c = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(10)], "source_file string, sequence_id int")
    got = context.neighbours(c, c.where("source_file = 'a' AND sequence_id = 5"))
    assert sorted(map(tuple, got.collect())) == [("a", i) for i in (2, 3, 4, 6, 7, 8)]


def test_vector_search_plan_has_no_cross_join(spark, small):
    from evidora.plans import catalogue_search

    plan = catalogue_search.vector_topk(spark, small)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_raw_issues(spark):
    raw = {"key": "AB-12", "fields": {"summary": " S ", "status": {"name": "Done"}, "components": [{"name": "x"}, "y"], "labels": [], "description": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hi"}]}]}}}
    r = files.raw_issues(spark.createDataFrame([(json.dumps(raw),)], "raw string")).first()
    assert (r["issue_key"], r["summary"], r["status"], r["components"], r["labels"], r["description"], r["assignee"]) == ("AB-12", "S", "Done", ["x", "y"], [], "hi\n", "Unassigned")


def test_json_source(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2


def test_json_sink(spark, tmp_path):
    rows = [(i, None if i % 3 else "ü\"x", [f"a{i}"]) for i in range(7)]
    df = spark.createDataFrame(rows, "i int, t string, l array<string>").repartition(3)
    files.write_json(df.unionByName(df.limit(0)), str(tmp_path / "j"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "j").glob("part-*")]
    assert sorted((r["i"], r["t"], r["l"]) for part in parts for r in part) == rows
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == rows


def test_frames():
    assert files.parse_frames("".join(files.event_frames([{"a": 1}, {"a": "ü"}]))) == [{"type": "token", "a": 1}, {"type": "token", "a": "ü"}]


def test_keep_sections():
    assert answers.keep_sections("## A\nx\n## B\ny\n### Ab c\nz", ["a"]) == "## A\nx\n\n### Ab c\nz"


def test_engine(spark, small, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), floor=0.2)
    assert e.health()["records"] == 0
    n = e.build(V.view(spark, small, V.DEFECTS).drop("doc_id"), V.view(spark, small, V.COMMENTS), False)
    got = e.ask("why did the publish fail with a mapping error")
    assert n == 200 and got["intent"] == "DEFECT_DIAGNOSTIC" and "## Suggested Fix Steps" in got["answer"] and got["similar_defects"]
    assert [x["type"] for x in e.ask_events("")] == ["error"]
    assert e.ask("hello")["intent"] == "GENERAL_HELP"
    again = e.upsert_defects(V.view(spark, small, V.DEFECTS).drop("doc_id").where("issue_key = 'EVD-1003'"))
    assert again == 200


def test_unit_vectors_equal_their_sql(spark, tmp_path):
    """Signs of what rounds to zero, halves, vectors of length zero, none and empty ones."""
    vecs = [[-1e-8, 1.0], [1e-8, -1.0], [-0.0, 2.0], [3.0, 4.0], [-5e-7, 1.0], [0.0, 0.0], [], None, [1e30, -1.0], [-0.5000005, 0.8660251]]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vecs)), pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    check(spark, "l2_normalize", str(tmp_path), entry)


def test_tables_are_completed_without_a_row_for_every_question(spark):
    """Rows are counted off by table, before they meet the questions that hold it; hits beyond the cut and of no table stay."""
    chunks = spark.range(40).selectExpr("concat('f', id % 2) AS source_file", "CAST(id AS int) AS sequence_id", "CASE WHEN id = 39 THEN 'TEXT' ELSE 'TABLE_ROW' END AS asset_type", "CASE WHEN id < 30 THEN concat('s', id % 4) END AS section")
    hits = chunks.where("sequence_id IN (0, 28, 3, 39, 34)").crossJoin(spark.sql("SELECT explode(array(7, 8)) AS qid")).where("qid = 7 OR sequence_id > 30").selectExpr("*", "sequence_id / 100D AS score")
    done = routes.complete_tables(chunks, hits, 3)
    got = sorted((r["qid"], r["source_file"], r["sequence_id"], r["score"]) for r in done.collect())
    assert got == [(7, "f0", 0, 0.0), (7, "f0", 4, 0.0), (7, "f0", 8, 0.0), (7, "f0", 28, 0.28), (7, "f0", 34, 0.34), (7, "f1", 3, 0.03), (7, "f1", 7, 0.0), (7, "f1", 11, 0.0), (7, "f1", 39, 0.39), (8, "f0", 34, 0.34), (8, "f1", 39, 0.39)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "qid" in x]
