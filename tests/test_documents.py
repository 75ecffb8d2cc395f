"""Documents from pages to answers: ingest, replacement, every route, context, validation, and a folder as a stream."""

import pytest
from pyspark.sql import functions as F

from evidora.operators import document_answers, document_chunks, documents
from evidora.plans import views as V
from evidora.plans.engine import Engine

PAGES = "source_file string, page bigint, markdown string"
WIDGETS = "| User Feature Flag | Coexist Feature Flag | Energy Default Baseline | EO Default Baseline | Energy Widget | Carbon Widget |"


def matrix(rows):
    return "\n".join([WIDGETS, "|---|---|---|---|---|---|", *rows])


GUIDE = [
    ("guide.md", 1, "# Setup Guide\n## Onboarding\nTo onboard a tenant, open the console and follow these steps one after another, as the wizard shows them to you.\n\nStep one: create the realm and note its zebra number for later use."),
    ("guide.md", 2, "Step two: invite the administrators and wait until they have confirmed, which can take a day."),
    ("guide.md", 3, "## Feature Flag Options\n| Feature Flag Name | Description | Product | Applicable |\n|---|---|---|---|\n| enableHeatMap | shows the heat map | Core | Yes |\n| allowExports | lets users export | Core | No |"),
    ("guide.md", 4, "| Feature Flag Name | Description | Product | Applicable |\n|---|---|---|---|\n| showQuokkaPanel | the quokka panel | Labs | Yes |"),
    ("guide.md", 5, "## Widget dashboard\n" + matrix(["| Enabled | Disabled | Yes | No | shown7 | hidden7 |", "| Disabled | Enabled | No | Yes | greyed8 | absent8 |"])),
    ("limits.md", 1, "# Limits\n## Quotas\nThe quotas of an account are listed below in full, and they are checked once an hour by a job.\n| Quota | Value |\n|---|---|\n| Uploads | 40 |\n| Seats | 25 |"),
    ("limits.md", 2, "## Contents\nIntroduction .................. 4\nQuotas .............................. 9\nEverything else ..................... 12\nAppendix ............................ 31"),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("docs")))
    seen = []
    prose = V.view(spark, "/root/testdata/sf0.001", "SELECT 'd' || CAST(doc_id % 20 AS STRING) || '.md' AS source_file, CAST(floor(doc_id / 20.0) AS BIGINT) + 1 AS page, '## Part ' || CAST(doc_id AS STRING) || chr(10) || text AS markdown FROM documents")
    e.ingest_document(prose.unionByName(spark.createDataFrame(GUIDE, PAGES)), progress=seen.append)
    assert [s["stage"] for s in seen] == ["parsing", "chunking", "embedding", "done"] and seen[-1]["chunks"] == e.pages.count() > 200
    return e


def test_chunks_of_a_document(spark):
    got = document_chunks.chunks_of(document_chunks.elements_of(spark.createDataFrame(GUIDE, PAGES))).collect()
    guide = sorted((r for r in got if r["source_file"] == "guide.md"), key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in guide] == list(range(1, len(guide) + 1))
    flags = [r for r in guide if r["table_type"] == "feature_flags"]
    assert sorted(r["asset_type"] for r in flags) == ["TABLE_FRAGMENT"] * 2 + ["TABLE_FULL"] + ["TABLE_ROW"] * 3 and len({r["group_id"] for r in flags}) == 1
    assert next(r for r in flags if r["asset_type"] == "TABLE_FULL")["page_info"] == "3-4"
    row = next(r for r in guide if r["asset_type"] == "TABLE_ROW" and r["user_feature_flag"] == "Enabled")
    assert (row["coexist_feature_flag"], row["energy_default_baseline"], row["eo_default_baseline"], row["energy_widget"], row["carbon_widget"]) == ("Disabled", "Yes", "No", "shown7", "hidden7")
    whole = next(r for r in guide if r["table_type"] == "conditional_matrix" and r["asset_type"] == "TABLE_FULL")
    assert whole["embed_text"].startswith("This is a widget configuration matrix") and "Total 2 configurations." in whole["embed_text"] and "Config: " in whole["embed_text"]
    assert not any("....." in r["display"] for r in got)


ROUTES = {
    "text_section": ("how to onboard a tenant in the console, what are the steps", ["zebra number", "Step two"]),
    "feature_flag_table": ("is the feature flag for the quokka panel applicable", ["enableHeatMap", "allowExports", "showQuokkaPanel"]),
    "table_full": ("show the full table of quotas: uploads and seats", ["Uploads", "Seats"]),
    "widget_matrix": ("user feature flag enabled, coexist feature flag disabled, energy default baseline yes, eo default baseline no", ["shown7"]),
    "hybrid": ("allowExports lets users export, enableHeatMap shows the heat map", ["allowExports"]),
}


@pytest.mark.parametrize("route", list(ROUTES))
def test_every_route_finds_its_row_and_what_stands_around(engine, route):
    question, planted = ROUTES[route]
    got = engine.ask_documents(question)
    assert got["route"] == route and all(x in got["answer"] for x in planted) and got["context"] == got["answer"] and got["validated"]
    assert 0 < len(got["sources"]) <= 50 and "......" not in got["context"]


def test_contents_pages_are_left_out_when_shown(spark):
    rows = [("dots", "One .... 3\n\nTwo words ………… 12\nplain"), ("half", "One .... 3\nplain"), ("none", None), ("few", "a ... 3\nb ... 4")]
    got = documents.drop_toc_chunks(spark.createDataFrame(rows, "k string, display string"), "display")
    assert sorted(r["k"] for r in got.collect()) == ["few", "half", "none"]


def test_answers_are_checked_against_the_row(engine):
    question = "user feature flag enabled, coexist feature flag disabled, energy default baseline yes, eo default baseline no"
    asked = []

    def writer(q, context, messages):
        asked.append((context, messages))
        return "It is SHOWN7 and Hidden7." if len(asked) > 1 else "The energy widget is shown7."

    got = engine.ask_documents(question, writer=writer, history=[{"question": f"q{i}", "answer": "a" if i % 2 else ""} for i in range(6)])
    assert got["answer"] == "It is SHOWN7 and Hidden7." and got["validated"] is False and len(asked) == 2
    assert "greyed8" not in asked[1][0] and "hidden7" in asked[1][0]
    assert [(m["role"], m["content"]) for m in asked[0][1]] == [("user", "q2"), ("user", "q3"), ("assistant", "a"), ("user", "q4"), ("user", "q5"), ("assistant", "a")]
    right = engine.ask_documents(question, writer=lambda q, c, m: "shown7, hidden7")
    assert right["validated"] is True


def test_many_questions_are_one_job(engine, spark):
    questions = spark.createDataFrame([(1, "what are the onboarding steps"), (2, "feature flag quokka"), (3, "user feature flag enabled"), (4, "full table quotas"), (5, "zebra")], "qid int, question string")
    asked, chunks = document_answers.ask(questions, F.col("question")), engine.pages.read()
    search = lambda some: document_answers.evidence(chunks, document_answers.route_hits(chunks, some, 5).persist(), 5)
    got = search(asked).collect()
    assert {r["qid"]: r["route"] for r in got} == {1: "text_section", 2: "feature_flag_table", 3: "widget_matrix", 4: "table_full", 5: "hybrid"}
    keys = [(r["qid"], r["source_file"], r["sequence_id"]) for r in got]
    assert len(keys) == len(set(keys))
    one = search(asked.where("qid = 2"))
    assert sorted((r["source_file"], r["sequence_id"], r["score"]) for r in one.collect()) == sorted((r["source_file"], r["sequence_id"], r["score"]) for r in got if r["qid"] == 2)


def test_a_file_that_comes_again_leaves_nothing_behind(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    assert e.ask_documents("what are the onboarding steps")["answer"].startswith("I searched")
    assert e.ask_documents("user feature flag enabled")["answer"].startswith("To answer this widget question")
    e.ingest_document(spark.createDataFrame(GUIDE, PAGES))
    other = e.pages.read().where("source_file = 'limits.md'").count()
    e.ingest_document(spark.createDataFrame([("guide.md", 1, "# New\n## Part\nOnly this paragraph is left of the guide, and it speaks of an okapi in some detail.")], PAGES))
    kept = e.pages.read().where("source_file = 'guide.md'").collect()
    assert len(kept) == 1 and "okapi" in kept[0]["display"] and e.pages.read().where("source_file = 'limits.md'").count() == other
    assert e.list_sources() == ["guide.md", "limits.md"]


def test_a_folder_of_documents_as_a_stream(spark, tmp_path):
    e, seen = Engine(spark, str(tmp_path / "e")), []
    folder = tmp_path / "in"
    (folder / "a").mkdir(parents=True)
    (folder / "a/guide.md").write_text("\f".join(m for s, _, m in GUIDE if s == "guide.md"))
    (folder / "a/limits.md").write_text("\f".join(m for s, _, m in GUIDE if s == "limits.md"))
    run = lambda: e.follow_documents(str(folder), str(tmp_path / "ckpt"), seen.append).awaitTermination()
    run()
    assert [s["stage"] for s in seen] == ["parsing", "chunking", "embedding", "done"] and e.list_sources() == ["guide.md", "limits.md"]
    assert e.pages.read().where("table_type = 'feature_flags' AND asset_type = 'TABLE_ROW'").count() == 3
    (folder / "b").mkdir()
    (folder / "b/guide.md").write_text("# New\n## Part\nThe guide was written again, and all it says now is that the okapi sleeps at noon every day.")
    before = len(seen)
    run()
    assert len(seen) == before + 4 and seen[-1]["batch"] > seen[0]["batch"]
    assert e.pages.read().where("source_file = 'guide.md'").count() == 1
    assert "okapi" in e.ask_documents("when does the okapi sleep")["answer"]


def test_chunks_of_an_issue_that_comes_again_are_replaced(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    issues = V.view(spark, "/root/testdata/sf0.001", V.DEFECTS).drop("doc_id").where("issue_key IN ('EVD-1002', 'EVD-1003')")
    e.build(issues.withColumn("description", F.lit("The aardvark export stopped. Fixed by a remap of the payload and a sync rerun of every aardvark job.")), drop_cancelled=False)
    before = {r["chunk_id"] for r in e.chunks.read().where("issue_key = 'EVD-1002' AND text LIKE '%aardvark%'").collect()}
    e.upsert_defects(issues.where("issue_key = 'EVD-1002'").withColumn("description", F.lit("")).withColumn("summary", F.lit("short")))
    kept = e.chunks.read().where("issue_key = 'EVD-1002'").collect()
    assert before and kept and not any("aardvark" in r["text"] for r in kept)
    assert e.records.count() == 2 and e.chunks.read().where("issue_key = 'EVD-1003' AND text LIKE '%aardvark%'").count() > 0


def test_history_reaches_the_writer(spark, small, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), floor=0.2)
    e.build(V.view(spark, small, V.DEFECTS).drop("doc_id"), drop_cancelled=False)
    got = e.ask("why did the publish fail with a mapping error", history=[{"question": "before", "answer": "yes"}], writer=lambda q, evidence, messages: f"{len(messages)} {evidence[:14]}")
    assert got["answer"] == "2 ## Root Causes"
