"""The engine as an application uses it: build, ask, ingest, upsert, health.

Tables live in a folder (``KeyedTable``): records by issue, chunks by issue, pages' chunks by file, so that an issue or a file that comes again
replaces all it had. Answers are deterministic; embedding providers and writers of answers are optional plug-ins.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import classify, vocab
from ..functions import text as T
from ..operators import answers, conversations, document_answers, document_chunks, lexical, records, retrieval, vectors
from ..operators.providers import EmbeddedTexts
from ..operators.upsert import KeyedTable
from ..sources import files, paged_issues

RECORDS = "issue_key string, summary string, description string, status string, resolution string, priority string, components array<string>, labels array<string>, environment string, product string, team string, is_fixed boolean, is_cancelled boolean, root_cause_extracted string, fix_applied_extracted string, workaround_extracted string, key_findings string, fix_pattern string, defect_type string, error_signature string, quality_score double, search_text string, problem_text string"
CHUNKS = "chunk_id string, issue_key string, chunk_type string, text string, summary string, status string, priority string, components array<string>, labels array<string>, environment string, product string, team string, fix_pattern string, defect_type string, quality_score double, is_fixed boolean, is_cancelled boolean, vec array<double>"
PAGES = "source_file string, sequence_id int, asset_type string, chunk_type string, section string, page_info string, table_type string, group_id string, " + ", ".join(f"{c} string" for c in document_chunks.ROW) + ", display string, embed_text string, vec array<double>"
#: Limits of the public calls.
MAX_QUESTION, MAX_BULK, MAX_UPLOAD_MB, MAX_TURNS = 2000, 200, 20, 4
#: Turns a question and its evidence into an answer: (question, context, messages before it).
Writer = Callable[[str, str, list[dict]], str]
MORE_CONDITIONS = "To answer this widget question I need more information.\nPlease also specify: **{}**\n\nRequired conditions: User Feature Flag, Coexist Feature Flag, Energy Default Baseline, EO Default Baseline."
SECTIONS = {"root_cause": ["Root Causes"], "resolve": ["How Similar Defects Were Fixed Earlier", "Suggested Fix Steps"], "similar": ["Similar Fixed Defects"]}
OPTIONS = [{"id": "root_cause", "label": "Root cause"}, {"id": "resolve", "label": "How to resolve it"}, {"id": "similar", "label": "Earlier similar defects"}]
HELP = "Ask about an issue, its root cause or similar issues, by text or by key."


class Engine:
    def __init__(self, spark: SparkSession, folder: str, floor: float = vocab.FLOOR, top_k: int = vocab.TOP_K, base_url: str = "", provider: vectors.EmbeddingProvider | None = None):
        self.spark, self.floor, self.top_k, self.base_url, self.provider = spark, floor, top_k, base_url, provider
        self.vectors = EmbeddedTexts(spark, f"{folder.rstrip('/')}/vectors", provider)
        table = lambda name, schema, key, many: KeyedTable(spark, f"{folder.rstrip('/')}/{name}", schema, [key], many=many)
        self.records, self.chunks, self.pages = table("records", RECORDS, "issue_key", False), table("chunks", CHUNKS, "issue_key", True), table("pages", PAGES, "source_file", True)

    # --- building -----------------------------------------------------------------------------------
    def build(self, issues: DataFrame, comments: DataFrame | None = None, drop_cancelled: bool = True) -> int:
        """Normalise, chunk and store issues; returns the number of records."""
        return self._store(issues, comments, drop_cancelled)

    def upsert_defects(self, issues: DataFrame, comments: DataFrame | None = None, limit: int = MAX_BULK) -> int:
        """Add or replace up to ``limit`` issues, cancelled ones too; with all their chunks."""
        return self._store(issues.limit(limit), comments, False)

    def add_found(self, options: dict[str, str]) -> Iterator[dict]:
        """Search, fetch and store issues of a paged search with their comments, as stages; ``options`` are those of ``sources.paged_issues``."""
        yield {"stage": "searching"}
        paged_issues.register(self.spark)
        raw = self.spark.read.format("paged_issues").options(**options, comments="true").load().persist()
        try:
            yield {"stage": "fetched", "issues": raw.count()}
            before = self.records.count()
            stored = self._store(files.raw_issues(raw), files.embedded_comments(raw), False)
            yield {"stage": "done", "records": stored, "new": stored - before}
        finally:
            raw.unpersist()

    def _store(self, issues: DataFrame, comments: DataFrame | None, drop_cancelled: bool) -> int:
        found = records.with_comments(issues, comments) if comments is not None else issues
        normal = records.normalize(found, drop_cancelled=drop_cancelled).persist()  # records and chunks are of the same issues
        try:
            self.records.apply(normal)
            self.chunks.apply(self.vectors.add(records.chunks(normal), "text"))
        finally:
            normal.unpersist()
        return self.records.count()

    def ingest_document(self, pages: DataFrame, name: str | None = None, progress: Callable[[dict], None] = lambda stage: None) -> int:
        """Chunk and store (source_file, page, markdown); the files named replace all their former chunks. Returns the number of chunks there are."""
        progress({"stage": "parsing"})
        elements = document_chunks.elements_of(pages).persist()
        try:
            progress({"stage": "chunking", "elements": elements.count()})
            fresh = document_chunks.chunks_of(elements).persist()
            try:
                progress({"stage": "embedding", "chunks": fresh.count()})
                self.pages.apply(self.vectors.add(fresh, "embed_text"), name)
            finally:
                fresh.unpersist()
        finally:
            elements.unpersist()
        stored = self.pages.count()
        progress({"stage": "done", "chunks": stored})
        return stored

    def follow_documents(self, folder: str, checkpoint: str, progress: Callable[[dict], None] = lambda stage: None) -> StreamingQuery:
        """Ingest the Markdown files that come into a folder, each whole, its pages parted by form feeds. A file of a known name replaces that document."""
        self.pages.recover()
        texts = self.spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1000).load(folder)
        named = texts.select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), "value")
        newest = Window.partitionBy("source_file").orderBy(F.desc("at"), F.desc("path"))

        def store(batch: DataFrame, number: int) -> None:
            files_ = batch.withColumn("__r", F.row_number().over(newest)).where("__r = 1")
            pages = files_.select("source_file", F.posexplode(F.split("value", "\f")).alias("p", "markdown")).select("source_file", (F.col("p") + 1).cast("bigint").alias("page"), "markdown")
            self.ingest_document(pages, f"{number}", lambda stage: progress({"batch": number, **stage}))

        return named.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # --- asking -------------------------------------------------------------------------------------
    def _question(self, question: str) -> DataFrame:
        if not question or not question.strip():
            raise ValueError("the question is empty")
        if len(question) > MAX_QUESTION:
            raise ValueError(f"the question is longer than {MAX_QUESTION} characters")
        return self.spark.createDataFrame([(1, question)], "qid int, question string")

    def search(self, questions: DataFrame, diagnostic: bool = True) -> DataFrame:
        """Retrieval results of (qid, question) with the records of their issues."""
        found = retrieval.retrieve(self.chunks.read(), self.records.read(), questions, self.top_k, diagnostic, self.floor, provider=self.provider)
        return found.join(self.records.read().drop("search_text", "problem_text"), "issue_key", "left")

    def similar(self, key: str) -> DataFrame:
        keys = self.spark.createDataFrame([(1, key)], "qid int, issue_key string")
        found = retrieval.retrieve_for_key(self.chunks.read(), self.records.read(), keys, self.top_k, self.floor, self.provider)
        return found.join(self.records.read().drop("search_text", "problem_text"), "issue_key", "left")

    def _messages(self, history: list[dict] | None) -> list[dict]:
        """The last turns ({question, answer}) as messages; empty ones are left out."""
        turns = (history or [])[-MAX_TURNS:]
        if not turns:
            return []
        rows = self.spark.createDataFrame([(i, t.get("question"), t.get("answer")) for i, t in enumerate(turns)], "turn int, question string, answer string")
        return [{"role": r["role"], "content": r["content"]} for r in conversations.history_messages(rows).orderBy("turn", F.desc("role")).collect()]

    def ask(self, question: str, mode: str = "auto", sections: list[str] | None = None, offer_options: bool = False, history: list[dict] | None = None, writer: Writer | None = None) -> dict:
        """Intent, answer and similar issues of one question; with ``offer_options`` first the choice of sections.

        A ``writer`` is given the deterministic answer as evidence, and the last turns of the history, which that answer itself doesn't depend on.
        """
        asked = self._question(question)
        row = asked.select(classify.intent(F.col("question"), F.lit(mode)).alias("i"), F.try_element_at(T.issue_keys(F.col("question")), F.lit(1)).alias("k")).first()
        if row["i"] == "GENERAL_HELP":
            return {"intent": row["i"], "answer": HELP, "similar_defects": []}
        if offer_options and not [s for s in sections or [] if s in SECTIONS]:
            return {"intent": row["i"], "mode": "options", "options": OPTIONS, "question": question, "similar_defects": []}
        found = self.similar(row["k"]) if row["i"] == "DEFECT_BY_KEY" else self.search(asked)
        found = found.orderBy("rank").cache()
        rows = [r.asDict() for r in found.drop("snippets", "chunk_types").collect()]  # top_k at most
        said = answers.answers(found, self.base_url).first()
        found.unpersist()
        text = said["answer"] if said else answers.fallback("no_chunks_found")
        if writer and said:
            text = writer(question, text, self._messages(history)) or text
        wanted = [t for s in sections or [] for t in SECTIONS.get(s, [])]
        return {"intent": row["i"], "answer": answers.keep_sections(text, wanted) if wanted and said else text, "similar_defects": rows}

    def ask_events(self, question: str, mode: str = "auto", words: int = 6) -> Iterator[dict]:
        """The same as events: meta, sources, tokens, done; or error."""
        try:
            got = self.ask(question, mode)
        except ValueError as wrong:
            yield {"type": "error", "message": str(wrong)}
            return
        yield {"type": "meta", "intent": got["intent"]}
        yield {"type": "sources", "similar_defects": got["similar_defects"]}
        parts = got["answer"].split(" ")
        for i in range(0, len(parts), words):
            yield {"type": "token", "text": " ".join(parts[i : i + words]) + (" " if i + words < len(parts) else "")}
        yield {"type": "done"}

    def ask_documents(self, question: str, k: int = 5, history: list[dict] | None = None, writer: Writer | None = None) -> dict:
        """Route, evidence in reading order, and the answer: what the ``writer`` makes of the evidence, else the evidence itself.

        An answer on a widget matrix that leaves out values of the exact row is written again from that row alone.
        """
        began = time.perf_counter()
        normal = self._question(question).select("qid", T.normalize_question(F.col("question")).alias("question"))
        asked = document_answers.ask(normal, F.col("question"), self.provider).persist()
        row = asked.drop("qvec").first()
        chunks = self.pages.read()
        hits = document_answers.route_hits(chunks, asked, k).persist()
        try:
            capped = document_answers.evidence(chunks, hits, k)
            found = self.spark.createDataFrame(capped.collect(), capped.schema)  # the cap bounds them; what follows needs no search
            shown = found.withColumn("page", F.col("page_info"))
            text = answers.context_blocks(shown).first()
            out = {"question": row["question"], "route": row["route"], "conditions": dict(row["conditions"]), "missing_conditions": list(row["missing"]), "sources": [r.asDict() for r in shown.orderBy("reading_order").select("source_file", "page", "section", "asset_type", "score").collect()]}  # the cap bounds them
            if text is None:
                needs = row["route"] == "widget_matrix" and row["missing"]
                said = MORE_CONDITIONS.format(", ".join(row["missing"])) if needs else answers.fallback("no_chunks_found")
                return out | {"context": said, "answer": said, "validated": None, "seconds": round(time.perf_counter() - began, 3)}
            messages = self._messages(history) if writer else []
            said = writer(row["question"], text["context"], messages) if writer else text["context"]
            wrong = document_answers.unsaid(found, asked, self.spark.createDataFrame([(1, said)], "qid int, answer string")).first()
            if wrong is not None:
                said = writer(row["question"], wrong["display"], messages) if writer else wrong["display"]
            return out | {"context": text["context"], "answer": said, "validated": wrong is None, "seconds": round(time.perf_counter() - began, 3)}
        finally:
            hits.unpersist()
            asked.unpersist()

    @staticmethod
    def check_upload(name: str, size: int) -> None:
        """Only PDF files that aren't empty, up to 20 MB."""
        if not name.lower().endswith(".pdf"):
            raise ValueError("only .pdf files are accepted")
        if not 0 < size <= MAX_UPLOAD_MB << 20:
            raise ValueError(f"the file is empty or larger than {MAX_UPLOAD_MB} MB")

    # --- state --------------------------------------------------------------------------------------
    def health(self) -> dict:
        """Never fails: what is there and how much of it."""
        out = {"status": "ok"}
        for name, store in (("records", self.records), ("chunks", self.chunks), ("pages", self.pages)):
            try:
                out[name] = store.count()
            except Exception as wrong:  # reported, as a health check must not raise
                out |= {"status": "degraded", name: str(wrong)[:200]}
        return out

    def diagnose(self) -> dict:
        """A live query from end to end."""
        began = time.perf_counter()
        try:
            n = self.search(self._question("why did the job fail")).count()
            return {"ok": True, "results": n, "seconds": round(time.perf_counter() - began, 3)}
        except Exception as wrong:  # the error is the diagnosis
            return {"ok": False, "error": str(wrong)[:500]}

    def term_statistics(self) -> DataFrame:
        return lexical.document_frequency(self.records.read(), "search_text")

    def list_sources(self) -> list[str]:
        return [r[0] for r in self.pages.read().where("source_file <> ''").select("source_file").distinct().orderBy("source_file").collect()]
