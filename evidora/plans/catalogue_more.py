"""Queries on routes, row texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, table_functions
from ..functions import text as T
from ..operators import context, conversations, routes, tables, vectors
from . import catalogue_documents, catalogue_search
from . import duck as D
from . import views as V

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_DOCS = f"SELECT e.source_file, CAST(e.pdf_page_number AS INTEGER) AS sequence_id, CASE WHEN element_type = 'TEXT' THEN 'TEXT' ELSE 'TABLE_ROW' END AS asset_type, CASE WHEN e.pdf_page_number % 3 = 0 THEN 'section_part' ELSE 'section_full' END AS chunk_type, 'S' || CAST(CAST(floor(e.pdf_page_number / 7.0) AS BIGINT) AS STRING) AS section, CASE WHEN e.pdf_page_number % 2 = 0 THEN 'feature_flags' ELSE 'conditional_matrix' END AS table_type, CASE WHEN e.pdf_page_number % 4 = 0 THEN 'Enabled' ELSE 'Disabled' END AS user_feature_flag, v.embedding FROM ({V.ELEMENTS}) e CROSS JOIN (SELECT max(vec_id) + 1 AS n FROM embeddings) m JOIN embeddings v ON v.vec_id = (CAST(substr(split_part(e.source_file, '-', 1), 4) AS BIGINT) * 50 + e.pdf_page_number) % m.n"
_ASKED = "SELECT vec_id AS qid, embedding AS qvec, CASE vec_id % 3 WHEN 0 THEN 'text_section' WHEN 1 THEN 'hybrid' ELSE 'table_full' END AS route FROM embeddings WHERE vec_id % 20 = 0"


def _tables(spark, sf_dir):
    V.register(spark, sf_dir, "documents", "embeddings")
    return spark.sql(_DOCS).withColumnRenamed("embedding", "vec"), spark.sql(_ASKED)


def _near(where: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_file || '||' || sequence_id) AS rank FROM (SELECT qid, route, d.* EXCLUDE (embedding), round(list_inner_product(qvec::DOUBLE[], embedding::DOUBLE[]), 4) AS score FROM ({_ASKED}) a JOIN ({_DOCS}) d ON {where}) s) r WHERE rank <= {k}"""


@query("document_search", f"SELECT qid, source_file, sequence_id, score FROM ({_near('TRUE', 5)}) x")
def document_search(spark, sf_dir):
    chunks, asked = _tables(spark, sf_dir)
    return routes.similarity_search(chunks, asked.select("qid", "qvec"), 5).select("qid", "source_file", "sequence_id", "score")


_HITS_BY_FLAG = "table_type = 'feature_flags' AND user_feature_flag = 'Enabled'"


@query("filtered_table_search", f"SELECT qid, source_file, sequence_id, score FROM ({_near(_HITS_BY_FLAG, 5)}) x")
def filtered_table_search(spark, sf_dir):
    chunks, asked = _tables(spark, sf_dir)
    return routes.filtered_table_search(chunks, asked.select("qid", "qvec"), 5, "feature_flags", {"user_feature_flag": "enabled", "eo": ""}).select("qid", "source_file", "sequence_id", "score")


@query("multi_query_search", f"SELECT qid, source_file, sequence_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, source_file, sequence_id ORDER BY score DESC, variant) AS r FROM (SELECT qid % 3 AS qid, qid AS variant, source_file, sequence_id, score FROM ({_near('TRUE', 10)}) x) y) z WHERE r = 1")
def multi_query_search(spark, sf_dir):
    chunks, asked = _tables(spark, sf_dir)
    hits = routes.similarity_search(chunks, asked.select("qid", "qvec"), 10)
    return routes.merge_variants(hits.withColumn("variant", F.col("qid")).withColumn("qid", F.col("qid") % 3)).select("qid", "source_file", "sequence_id", "score")


_BASE = f"""n AS ({_near('TRUE', 50)}), tx AS (SELECT qid, route, source_file, sequence_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN chunk_type = 'section_full' THEN 0 ELSE 1 END, score DESC, source_file, sequence_id) AS r FROM n WHERE route = 'text_section') x WHERE r <= 15),
 al AS (SELECT qid, route, source_file, sequence_id, section, asset_type, score FROM n WHERE route = 'hybrid' UNION ALL SELECT qid, route, source_file, sequence_id, section, asset_type, score FROM ({_near("asset_type = 'TABLE_ROW'", 50)}) w WHERE route = 'table_full'),
 ex AS (SELECT DISTINCT h.qid, h.route, d.source_file, d.sequence_id FROM al h JOIN ({_DOCS}) d ON h.asset_type = 'TABLE_ROW' AND d.asset_type = 'TABLE_ROW' AND h.source_file = d.source_file AND h.section = d.section),
 cm AS (SELECT coalesce(a.qid, e.qid) AS qid, coalesce(a.route, e.route) AS route, coalesce(a.source_file, e.source_file) AS source_file, coalesce(a.sequence_id, e.sequence_id) AS sequence_id, coalesce(a.score, 0.0) AS score FROM al a FULL JOIN ex e ON a.qid = e.qid AND a.source_file = e.source_file AND a.sequence_id = e.sequence_id),
 hy AS (SELECT qid, route, source_file, sequence_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_file, sequence_id) AS r FROM cm WHERE route = 'hybrid') x WHERE r <= 15)"""


@query("route_retrieval", f"WITH {_BASE} SELECT * FROM tx UNION ALL SELECT * FROM hy UNION ALL SELECT qid, route, source_file, sequence_id, score FROM cm WHERE route = 'table_full'")
def route_retrieval(spark, sf_dir):
    chunks, asked = _tables(spark, sf_dir)
    return routes.route_hits(chunks, asked).select("qid", "route", "source_file", "sequence_id", "score")


_FOLLOW = "SELECT event_id % 50 AS qid, event_id // 50 % 6 AS pos, event_type AS candidate, value / 100.0 AS score FROM events"


@query("validated_followups", f"WITH h AS ({_FOLLOW}), g AS (SELECT qid, pos FROM h GROUP BY qid, pos HAVING count(*) FILTER (WHERE score >= 0.62) >= 2) SELECT qid, pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS INTEGER) AS place FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 3")
def validated_followups(spark, sf_dir):
    V.register(spark, sf_dir, "events")
    h = spark.sql(_FOLLOW.replace("event_id // 50", "event_id DIV 50"))
    return routes.validated_followups(h.select("qid", "pos").distinct(), h).select("qid", "pos", "place")


_GROUPS = "SELECT CAST(CAST(floor(l_orderkey / 200.0) AS BIGINT) AS STRING) AS group_id, CASE WHEN l_linenumber = 1 THEN 'TABLE_FULL' ELSE 'TABLE_ROW' END AS asset_type, 'f' AS source_file, l_orderkey * 10 + l_linenumber AS sequence_id FROM lineitem"


@query("table_group_rows", f"SELECT group_id, asset_type, sequence_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, asset_type ORDER BY source_file, sequence_id) AS r FROM ({_GROUPS}) g) x WHERE r <= CASE WHEN asset_type = 'TABLE_FULL' THEN 1 ELSE 20 END")
def table_group_rows(spark, sf_dir):
    V.register(spark, sf_dir, "lineitem")
    rows = spark.sql(_GROUPS)
    return routes.group_rows(rows, rows.select("group_id").distinct(), 20).select("group_id", "asset_type", "sequence_id")


_CELLS = "SELECT o_orderkey AS id, lower(o_orderpriority) AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'ena' ELSE 'Disabled' END AS state, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE o_orderstatus END AS product FROM orders"


@query("row_texts", f"""SELECT id, 'Feature flag row for ' || label || '. flag' || CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END || 'Rows feature flag.' || CASE WHEN product <> '' THEN ' Product ' || product || '.' ELSE '' END AS flag_text,
 'Widget matrix row. Coexist Feature Flag ' || CASE WHEN state = 'ena' THEN 'Enabled' ELSE state END || '.' AS matrix_text FROM ({_CELLS}) c""")
def row_texts(spark, sf_dir):
    """Texts of a flag row and of a matrix row made of every order."""
    V.register(spark, sf_dir, "orders")
    rows = spark.sql(_CELLS).withColumn("flag", F.when(F.col("id") % 2 == 0, "flagevenRows").otherwise("flagoddRows"))
    r = tables.flag_row(F.array(*map(F.lit, ["Description", "Flag name", "Product"])), F.array("label", "flag", "product"))
    m = tables.matrix_row(F.array(*map(F.lit, ["Description", "Coexist"])), F.array("label", "state"))
    return rows.select("id", tables.flag_row_text(r).alias("flag_text"), tables.matrix_row_text(m).alias("matrix_text"))


@query("whole_table_text", f"SELECT source_file, pdf_page_number AS page, 'This table lists feature flag configuration options for the Flags section. It has 1 rows with columns: flag | level | product.' || chr(10) || 'Row: ' || array_to_string(list_transform(string_split(regexp_replace(string_split(content, chr(10))[3], '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c)), ' — ') AS embed_text FROM ({V.ELEMENTS}) e WHERE element_type = 'TABLE'")
def whole_table_text(spark, sf_dir):
    t = tables.parse_table(V.view(spark, sf_dir, catalogue_documents._TABLES), "content")
    return t.select("source_file", "page", tables.table_text(F.col("headers"), F.col("rows"), F.lit("Flags"), F.col("page"), F.lit("feature_flags")).alias("embed_text"))


@query("table_json", f"SELECT source_file, pdf_page_number AS page, '{{\"headers\":[\"flag\",\"level\",\"product\"],\"rows\":[[' || array_to_string(list_transform(string_split(regexp_replace(string_split(content, chr(10))[3], '^\\|+|\\|+$', '', 'g'), '|'), lambda c: '\"' || trim(c) || '\"'), ',') || ']]}}' AS full_table_json FROM ({V.ELEMENTS}) e WHERE element_type = 'TABLE'")
def table_json(spark, sf_dir):
    t = tables.parse_table(V.view(spark, sf_dir, catalogue_documents._TABLES), "content")
    return t.select("source_file", "page", tables.json_of(F.col("headers"), F.col("rows")).alias("full_table_json"))


_TITLES = "SELECT conv_id, CAST(conv_id % 7 = 0 AS BOOLEAN) AS pinned, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id"
_TITLE = f"CASE WHEN c = '' THEN 'New chat' WHEN length(c) > 48 THEN regexp_replace(left(c, 48), '\\s+$', '') || '…' ELSE c END"
_TITLED = f"SELECT conv_id, pinned, {_TITLE} AS title FROM (SELECT conv_id, pinned, {D.strip(chr(39).join(['regexp_replace(first, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))} AS c FROM ({_TITLES}) t) u"


def _titled(spark, sf_dir):
    V.register(spark, sf_dir, "conversations")
    t = spark.sql(_TITLES.replace("arg_min(", "min_by("))
    return t.select("conv_id", "pinned", conversations.derive_title(F.col("first")).alias("title"))


@query("derive_titles", _TITLED)
def derive_titles(spark, sf_dir):
    return _titled(spark, sf_dir)


@query("title_search", f"SELECT conv_id, title, pinned FROM ({_TITLED}) x WHERE contains(lower(title), 'the')")
def title_search(spark, sf_dir):
    return conversations.search_titles(_titled(spark, sf_dir), " The ")


@query("conversation_changes", f"SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'Renamed' ELSE title END AS title, CASE WHEN conv_id % 5 = 2 THEN TRUE WHEN conv_id % 5 = 3 THEN FALSE ELSE pinned END AS pinned FROM ({_TITLED}) x WHERE conv_id % 5 <> 4")
def conversation_changes(spark, sf_dir):
    t = _titled(spark, sf_dir)
    op = F.when(F.col("conv_id") % 5 == 1, "rename").when(F.col("conv_id") % 5 == 2, "pin").when(F.col("conv_id") % 5 == 3, "unpin").when(F.col("conv_id") % 5 == 4, "delete")
    return conversations.change(t, t.select("conv_id", op.alias("op"), F.lit(" Renamed ").alias("title"))).select("conv_id", "title", "pinned")


_BUCKET = "CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 days' WHEN d <= 30 THEN 'Previous 30 days' ELSE strftime(ts, '%B %Y') END"


@query("date_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT {_BUCKET} AS bucket FROM (SELECT ts, date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) AS d FROM events) x) y GROUP BY bucket")
def date_buckets(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).groupBy(conversations.date_bucket(F.col("ts"), F.col("now")).alias("bucket")).agg(F.count("*").alias("n"))  # one row


@query("relative_times")
def relative_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", conversations.relative_time(F.col("ts"), F.col("now")).alias("ago"))  # one row


_PAIRS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS question, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS answer FROM documents"


@query("history_messages", f"SELECT doc_id, 0 AS side, 'user' AS role, {D.strip('question')} AS content FROM ({_PAIRS}) p WHERE {D.strip('question')} <> '' UNION ALL SELECT doc_id, 1, 'assistant', {D.strip('answer')} FROM ({_PAIRS}) p WHERE {D.strip('answer')} <> ''")
def history_messages(spark, sf_dir):
    V.register(spark, sf_dir, "documents")
    return conversations.history_messages(spark.sql(_PAIRS)).select("doc_id", "side", "role", "content")


@query("evidence_prompts")
def evidence_prompts(spark, sf_dir):
    return conversations.prompts(V.view(spark, sf_dir, V.QUESTIONS), catalogue_search._results(spark, sf_dir))


@query("embedded_texts", f"SELECT vec_id AS doc_id, round(sqrt(sum(n * n)), 6) AS raw_norm FROM (SELECT doc_id AS vec_id, CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({D.tokens('text')}) AS t FROM documents) x GROUP BY ALL) y GROUP BY vec_id")
def embedded_texts(spark, sf_dir):
    """Length of the raw bucket counts behind each hashed embedding: tokens over the largest share."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", vectors.embed(F.col("text")).alias("v"), F.size(T.tokens(F.col("text"))).alias("n"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return d.where("n > 0").select("doc_id", F.round(F.col("n") / total, 6).alias("raw_norm"))


_INTENT = catalogue_search.QUERIES["intent_route"][1]


@query("mode_override", f"SELECT qid, CASE WHEN intent = 'GENERAL_HELP' THEN 'DEFECT_DIAGNOSTIC' ELSE intent END AS intent FROM ({_INTENT}) x")
def mode_override(spark, sf_dir):
    return V.view(spark, sf_dir, V.QUESTIONS).select("qid", classify.intent(F.col("question"), F.lit("defect")).alias("intent"))


@query("reading_context")
def reading_context(spark, sf_dir):
    from ..operators import answers

    chunks, asked = _tables(spark, sf_dir)
    hits = routes.route_hits(chunks, asked)
    capped = context.smart_cap(hits.join(chunks.drop("vec"), ["source_file", "sequence_id"]))
    return answers.context_blocks(capped.withColumn("page", F.col("sequence_id")).withColumn("display", F.col("section")))


_MARKDOWN = "SELECT 'f' || CAST(CAST(floor(doc_id / 50.0) AS BIGINT) AS STRING) || '.md' AS source_file, doc_id AS page, CASE WHEN doc_id % 2 = 0 THEN 'Before ' || md5(text) || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | ' || source || ' |' || chr(10) || 'After ![shot ' || CAST(doc_id AS STRING) || '](x.png)' ELSE '  Only ' || md5(text) || chr(10) END AS markdown, md5(text) AS d, lang, source FROM documents"


@query("elements_by_table_function", f"""WITH m AS ({_MARKDOWN}), p AS (SELECT source_file, page, 0 AS i, 'TEXT' AS element_type, CASE WHEN page % 2 = 0 THEN 'Before ' ELSE 'Only ' END || d AS content FROM m
 UNION ALL SELECT source_file, page, 1, 'TABLE', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | ' || source || ' |' FROM m WHERE page % 2 = 0 UNION ALL SELECT source_file, page, 2, 'TEXT', 'After shot ' || page FROM m WHERE page % 2 = 0)
SELECT source_file, page, element_type, content, CAST(row_number() OVER (PARTITION BY source_file ORDER BY page, i) - 1 AS INTEGER) AS ord FROM p""")
def elements_by_table_function(spark, sf_dir):
    """Pages of every file cut in order by one SQL statement; numbers go on from page to page."""
    table_functions.register(spark)
    V.view(spark, sf_dir, _MARKDOWN).select("source_file", "page", "markdown").createOrReplaceTempView("evidora_pages")
    return spark.sql("SELECT source_file, page, element_type, content, ord FROM document_elements(TABLE(evidora_pages) PARTITION BY source_file ORDER BY page)")


_SAID = "SELECT doc_id, '## Root Causes' || chr(10) || md5(text) || chr(10) || '## How Fixed' || chr(10) || lang || chr(10) || chr(10) || '### Root notes ' || chr(10) || source AS answer, lang, source, md5(text) AS d FROM documents"


@query("sections_by_table_function", f"""WITH a AS ({_SAID}), s AS (SELECT doc_id, CAST(1 AS INTEGER) AS place, 'Root Causes' AS title, '## Root Causes' || chr(10) || d AS section FROM a WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, CAST(2 AS INTEGER), 'Root notes', '### Root notes ' || chr(10) || source FROM a WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'How Fixed', '## How Fixed' || chr(10) || lang FROM a WHERE doc_id % 3 = 1) SELECT * FROM s""")
def sections_by_table_function(spark, sf_dir):
    """Wanted sections of every answer, by LATERAL: two kinds of wishes, and none."""
    table_functions.register(spark)
    V.view(spark, sf_dir, _SAID).createOrReplaceTempView("evidora_answers")
    return spark.sql("SELECT a.doc_id, s.place, s.title, s.section FROM evidora_answers a, LATERAL answer_sections(a.answer, CASE doc_id % 3 WHEN 0 THEN array('ROOT') WHEN 1 THEN array('fixed') ELSE array() END) s")
