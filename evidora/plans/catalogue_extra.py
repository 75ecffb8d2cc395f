"""Queries on hybrid search, stored indexes, headings, insights, embedded comments and rows of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answer_texts
from ..operators import answers, context, conversations, documents, hybrid, lexical, records, routes, tables, upsert
from ..sources import files
from . import catalogue_search
from . import duck as D
from . import views as V
from .catalogue_streams import shared_folder

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_WITH_VECTORS = "SELECT d.doc_id AS item, d.text, d.source AS source_file, CASE WHEN d.n_chars % 2 = 0 THEN 'TEXT' WHEN d.n_chars % 3 = 0 THEN 'IMAGE' ELSE 'TABLE_ROW' END AS asset_type, v.embedding AS vec FROM documents d CROSS JOIN (SELECT max(vec_id) + 1 AS n FROM embeddings) m JOIN embeddings v ON v.vec_id = d.doc_id % m.n"
_ASKED = "SELECT b.item_id AS qid, b.text AS question, v.embedding AS qvec FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id"
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1)"


def _hybrid_sql(where: str) -> str:
    return f"""WITH q AS ({_ASKED}), c AS (SELECT * FROM ({_WITH_VECTORS}) x WHERE {where}),
 dn AS (SELECT qid, item, text, row_number() OVER (PARTITION BY qid ORDER BY round(list_inner_product(qvec::DOUBLE[], vec::DOUBLE[]), 6) DESC, item) AS dense_rank FROM q, c QUALIFY dense_rank <= 50),
 w AS (SELECT qid, item, dense_rank, {_WORDS.format("text")} AS w FROM dn), sz AS (SELECT qid, count(*) AS n, avg(len(w)) AS avgdl FROM w GROUP BY qid),
 qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_WORDS.format("question")}) AS term FROM q) u GROUP BY ALL),
 tf AS (SELECT w.qid, item, len(w) AS dl, term, times, count(*) AS tf FROM (SELECT qid, item, w, unnest(w) AS term FROM w) w JOIN qt USING (qid, term) GROUP BY ALL),
 df AS (SELECT *, count(*) OVER (PARTITION BY qid, term) AS df FROM tf),
 s AS (SELECT qid, item, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25 FROM df JOIN sz USING (qid) GROUP BY ALL),
 r AS (SELECT w.qid, w.item, dense_rank, row_number() OVER (PARTITION BY w.qid ORDER BY coalesce(bm25, 0) DESC, dense_rank) AS bm25_rank FROM w LEFT JOIN s USING (qid, item)),
 f AS (SELECT *, round(1 / (60.0::DOUBLE + dense_rank) + 1 / (60.0::DOUBLE + bm25_rank), 6) AS rrf FROM r)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dense_rank) AS rank FROM f QUALIFY rank <= 10"""


def _hybrid(spark, sf_dir, **only):
    V.register(spark, sf_dir, "documents", "embeddings", "benchmark")
    return hybrid.hybrid_search(spark.sql(_WITH_VECTORS), spark.sql(_ASKED), 10, **only)


@query("rrf_hybrid", _hybrid_sql("TRUE"))
def rrf_hybrid(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query("hybrid_by_assets", _hybrid_sql("source_file = 'src3' AND asset_type IN ('TEXT', 'TABLE_ROW')"))
def hybrid_by_assets(spark, sf_dir):
    return _hybrid(spark, sf_dir, source_file="src3", asset_types=["TEXT", "TABLE_ROW"])


@query("image_search", _hybrid_sql("asset_type IN ('IMAGE')"))
def image_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, asset_types=["IMAGE"])


@query("stored_index_search", catalogue_search._bm25_sql(10))
def stored_index_search(spark, sf_dir):
    """The index is written once and only read by the search."""
    index = lexical.StoredIndex(spark, shared_folder(spark)).build(V.table(spark, sf_dir, "documents"))
    return index.top(V.view(spark, sf_dir, V.QUESTIONS), 10)


_LEVELS = f"SELECT *, CASE WHEN pdf_page_number % 2 = 0 THEN 'Step ' || CAST(pdf_page_number AS STRING) END AS h3_here FROM ({V.WHOLE_FILES}) e0"


@query("heading_levels", f"""WITH e AS ({_LEVELS}), p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY pdf_page_number) AS pos FROM e),
 f AS (SELECT *, last_value(h1_here IGNORE NULLS) OVER u AS a, coalesce(max(CASE WHEN h1_here IS NOT NULL THEN pos END) OVER u, 0) AS pa, last_value(h2_here IGNORE NULLS) OVER u AS b, coalesce(max(CASE WHEN h2_here IS NOT NULL THEN pos END) OVER u, 0) AS pb,
  last_value(h3_here IGNORE NULLS) OVER u AS c, coalesce(max(CASE WHEN h3_here IS NOT NULL THEN pos END) OVER u, 0) AS pc FROM p WINDOW u AS (PARTITION BY source_file ORDER BY pdf_page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 h AS (SELECT source_file, pdf_page_number, a AS h1, CASE WHEN pb >= pa THEN b END AS h2, CASE WHEN pc >= pa AND pc >= pb THEN c END AS h3 FROM f)
SELECT *, coalesce(h3, h2, h1, '') AS section_title, concat_ws(' > ', h1, h2, h3) AS parent_path FROM h""")
def heading_levels(spark, sf_dir):
    filled = documents.heading_levels(V.view(spark, sf_dir, _LEVELS), ["pdf_page_number"])
    return filled.select("source_file", "pdf_page_number", "h1", "h2", "h3", "section_title", "parent_path")


@query("plain_elements", f"SELECT content, element_type, pdf_page_number, pdf_page_number AS llamaparse_page_number, source_file, h1_here AS heading_h1, h2_here AS heading_h2 FROM ({V.ELEMENTS}) e")
def plain_elements(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.ELEMENTS).withColumnsRenamed({"h1_here": "h1", "h2_here": "h2"})
    return documents.plain_elements(rows).select("content", "element_type", "pdf_page_number", "llamaparse_page_number", "source_file", "heading_h1", "heading_h2")


_INSIGHTS = "SELECT 'EVD-' || CAST(1000 + o_orderkey AS STRING) AS issue_key, CASE WHEN o_orderkey % 3 = 0 THEN 'Cause of ' || o_orderpriority END AS root_cause, 'Fix ' || o_orderstatus AS fix_applied, CASE WHEN o_orderkey % 2 = 0 THEN 'Found' END AS key_finding, CAST(NULL AS STRING) AS workaround FROM orders"


@query("insight_join", f"SELECT d.issue_key, i.root_cause AS ci_root, i.fix_applied AS ci_fix, i.key_finding AS ci_finding, i.workaround AS ci_workaround FROM ({V.DEFECTS}) d LEFT JOIN ({_INSIGHTS}) i USING (issue_key)")
def insight_join(spark, sf_dir):
    return records.with_insights(V.view(spark, sf_dir, V.DEFECTS), V.view(spark, sf_dir, _INSIGHTS)).select("issue_key", "ci_root", "ci_fix", "ci_finding", "ci_workaround")


@query("issue_chunk_ids", f"SELECT issue_key, list_sort(list(DISTINCT chunk_id)) AS chunk_ids FROM ({V.CHUNKS}) c GROUP BY issue_key")
def issue_chunk_ids(spark, sf_dir):
    return records.chunk_ids(V.view(spark, sf_dir, V.CHUNKS))


_TREE = "struct('doc' AS type, array(struct('paragraph' AS type, array(struct('text' AS type, text AS text)) AS content)) AS content)"


@query("embedded_comments", "SELECT 'EVD-' || CAST(conv_id AS STRING) AS issue_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN turn % 3 = 0 THEN 'Agent ' || role ELSE role END AS author, '2024-01-0' || CAST(1 + turn % 9 AS VARCHAR) AS created, CASE WHEN turn % 2 = 1 THEN text || chr(10) ELSE text END AS body FROM conversations")
def embedded_comments(spark, sf_dir):
    V.register(spark, sf_dir, "conversations")
    quoted = lambda c: f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"
    author = f"CASE WHEN turn % 3 = 0 THEN to_json(struct('Agent ' || role AS displayName)) ELSE {quoted('role')} END"
    body = f"CASE WHEN turn % 2 = 1 THEN to_json({_TREE}) ELSE {quoted('text')} END"
    one = f"""'{{"author":' || {author} || ',"created":"2024-01-0' || CAST(1 + turn % 9 AS STRING) || 'T10:00:00","body":' || {body} || '}}'"""
    grouped = spark.sql(f"SELECT conv_id, concat_ws(',', transform(array_sort(collect_list(struct(turn, {one} AS j))), x -> x.j)) AS js FROM conversations GROUP BY conv_id")
    raw = grouped.selectExpr("""'{"key":"EVD-' || CAST(conv_id AS STRING) || '","fields":{"comment":{"comments":[' || js || ']}}}' AS raw""")
    return files.embedded_comments(raw)


_VARIANTS = "SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id"


@query("query_variants", f"""WITH v AS ({_VARIANTS}), f AS (SELECT conv_id, said[1] AS question, lower(coalesce(said[2], '')) AS rewritten, list_concat(list_transform(said[1:3], lambda x: ' ' || lower(x)), said[2:4]) AS variants FROM v),
 k AS (SELECT conv_id, question, rewritten, list_transform(variants[1:4], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS plain FROM f)
SELECT conv_id, list_filter(plain, lambda x, i: x <> '' AND lower(x) NOT IN (lower({D.strip("question")}), lower({D.strip("rewritten")})) AND list_position(list_transform(plain, lambda y: lower(y)), lower(x)) = i) AS variants FROM k""")
def query_variants(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.col("t.text").alias("said"))
    asked = said.selectExpr("conv_id", "said[0] AS question", "lower(coalesce(get(said, 1), '')) AS rewritten", "concat(transform(slice(said, 1, 3), x -> ' ' || lower(x)), slice(said, 2, 3)) AS variants")
    return asked.select("conv_id", conversations.distinct_variants(F.col("question"), F.col("rewritten"), F.col("variants"), 4).alias("variants"))


@query("fused_answers", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE {D.text(answer_texts.DEFECT_HEADER)} || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {D.text(answer_texts.DOC_HEADER)} || chr(10) || chr(10) || lang END AS answer, trim(text) AS question FROM documents")
def fused_answers(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", answers.fused_answer(F.col("text"), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("answer"), answers.document_question(F.col("text")).alias("question"))


@query("paged_scroll", "SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 250")
def paged_scroll(spark, sf_dir):
    return upsert.scroll(V.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 250, 100)


_POINTS = f"SELECT DISTINCT source_file, pdf_page_number AS sequence_id, element_type FROM ({V.ELEMENTS}) e"
_WANTED = "SELECT source || '-' || CAST(CAST(floor(doc_id / 10000.0) AS BIGINT) AS STRING) AS source_file, n_chars % 40 AS sequence_id FROM documents"


@query("point_lookup", f"SELECT * FROM ({_POINTS}) p WHERE (source_file, sequence_id) IN (SELECT source_file, sequence_id FROM ({_WANTED}) w)")
def point_lookup(spark, sf_dir):
    return context.points(V.view(spark, sf_dir, _POINTS), V.view(spark, sf_dir, _WANTED)).select("source_file", "sequence_id", "element_type")


_HEADERS = ["User Feature Flag", "Coexist Flag", "Energy Default Baseline", "EO Default", "Energy Widget", "Carbon Widget", "EO Widget - Gas"]
_ROWS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'Enabl ed' WHEN 'F' THEN 'disabled' ELSE '' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'Disabled' WHEN o_orderkey % 3 = 1 THEN '' ELSE 'N/A' END AS b,
 CASE WHEN o_orderkey % 4 = 0 THEN 'YES' WHEN o_orderkey % 4 = 1 THEN 'no' WHEN o_orderkey % 4 = 2 THEN 'enabled' ELSE '' END AS c, CASE WHEN o_orderkey % 5 = 0 THEN 'No' ELSE '' END AS d, ' ' || o_orderpriority AS e, 'w' || CAST(o_custkey AS STRING) AS f, '' AS g FROM orders"""


@query("matrix_rows", f"""WITH r AS ({_ROWS}), n AS (SELECT id, CASE a WHEN 'Enabl ed' THEN 'Enabled' WHEN 'disabled' THEN 'Disabled' ELSE '' END AS u, b AS x, CASE c WHEN 'YES' THEN 'Yes' WHEN 'no' THEN 'No' WHEN 'enabled' THEN 'Yes' ELSE '' END AS y, d AS z, trim(e) AS e, f, g FROM r),
 s AS (SELECT *, concat_ws('_', CASE WHEN u <> '' THEN 'user_' || lower(u) END, CASE WHEN x <> '' THEN 'coexist_' || CASE x WHEN 'N/A' THEN 'na' ELSE lower(x) END END, CASE WHEN y <> '' THEN 'energy_' || lower(y) END, CASE WHEN z <> '' THEN 'eo_' || lower(z) END) AS i,
  concat_ws(' | ', CASE WHEN u <> '' THEN 'User ' || u END, CASE WHEN x <> '' THEN 'Coexist ' || x END, CASE WHEN y <> '' THEN 'Energy Default ' || y END, CASE WHEN z <> '' THEN 'EO Default ' || z END) AS l FROM n)
SELECT id, CASE WHEN i <> '' THEN 'widget_' || i ELSE 'widget_row_' || CAST(id AS VARCHAR) END AS row_id, CASE WHEN l <> '' THEN l ELSE 'Widget Row ' || CAST(id AS VARCHAR) END AS row_label, u AS user_feature_flag, x AS coexist_feature_flag, y AS energy_default_baseline, z AS eo_default_baseline,
 e AS energy_widget, f AS carbon_widget, '' AS eo_widget_all_utilities, '' AS eo_widget_electricity, g AS eo_widget_gas, '' AS eo_widget_hot_water FROM s""")
def matrix_rows(spark, sf_dir):
    rows = V.view(spark, sf_dir, _ROWS).select("id", F.array(*"abcdefg").alias("cells"))
    return rows.select("id", tables.matrix_row(F.array(*map(F.lit, _HEADERS)), F.col("cells"), F.col("id")).alias("m")).select("id", "m.*")


_TABLE_ROWS = """SELECT o_custkey AS page, o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'Enabled' ELSE 'Disabled' END AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS e FROM orders"""


@query("table_row_chunks", f"""SELECT 'orders' AS source_file, page, 'conditional_matrix' AS table_type, CAST(row_number() OVER (PARTITION BY page ORDER BY k) AS INTEGER) AS row_index, 'TABLE_ROW' AS asset_type,
 'Widget matrix row. User Feature Flag ' || u || '. Energy Default Baseline ' || e || '.' AS embed_text, u AS user_feature_flag, '' AS coexist_feature_flag, e AS energy_default_baseline, '' AS eo_default_baseline FROM ({_TABLE_ROWS}) t""")
def table_row_chunks(spark, sf_dir):
    grouped = V.view(spark, sf_dir, _TABLE_ROWS).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", F.array("u", "e").alias("cells")))).alias("r"))
    parsed = grouped.select(F.lit("orders").alias("source_file"), "page", F.lit("Widget dashboard").alias("section"), F.array(F.lit("User Feature Flag"), F.lit("Energy Default Baseline")).alias("headers"), F.col("r.cells").alias("rows"))
    return tables.row_chunks(parsed)


_MATRIX = """SELECT 'm' AS source_file, o.o_orderkey AS sequence_id, 'TABLE_ROW' AS asset_type, CASE WHEN o.o_orderkey % 5 = 0 THEN 'feature_flags' ELSE 'conditional_matrix' END AS table_type, 'T' || CAST(o.o_custkey % 9 AS STRING) AS section,
 CASE o.o_orderkey % 2 WHEN 0 THEN 'Enabled' ELSE 'Disabled' END AS user_feature_flag, CASE o.o_custkey % 2 WHEN 0 THEN 'Enabled' ELSE 'Disabled' END AS coexist_feature_flag, CASE o.o_custkey % 3 WHEN 0 THEN 'Yes' ELSE 'No' END AS energy_default_baseline, CASE o.o_orderkey % 7 WHEN 0 THEN 'Yes' ELSE 'No' END AS eo_default_baseline,
 'w' || CAST(o.o_orderkey AS STRING) AS energy_widget, o.o_orderpriority AS carbon_widget, v.embedding AS vec FROM orders o CROSS JOIN (SELECT max(vec_id) + 1 AS n FROM embeddings) m JOIN embeddings v ON v.vec_id = o.o_orderkey % m.n"""
_STATED = "SELECT vec_id AS qid, embedding AS qvec, CASE WHEN vec_id % 3 = 0 THEN 'Enabled' END AS user_feature_flag, CASE WHEN vec_id % 6 < 5 THEN 'Disabled' END AS coexist_feature_flag, CASE WHEN vec_id % 9 = 0 THEN 'Yes' END AS energy_default_baseline, CASE WHEN vec_id % 9 = 0 THEN 'No' END AS eo_default_baseline FROM embeddings WHERE vec_id % 20 = 0"
_FIELDS = ("user_feature_flag", "coexist_feature_flag", "energy_default_baseline", "eo_default_baseline")
_MATRIX_SQL = f"""SELECT qid, source_file, sequence_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_file || '||' || sequence_id) AS rank FROM (SELECT qid, source_file, sequence_id, {" AND ".join(f"q.{f} IS NOT NULL" for f in _FIELDS)} AS whole,
 round(list_inner_product(qvec::DOUBLE[], vec::DOUBLE[]), 4) AS score FROM ({_STATED}) q JOIN ({_MATRIX}) m ON table_type = 'conditional_matrix' AND {" AND ".join(f"(q.{f} IS NULL OR q.{f} = m.{f})" for f in _FIELDS)}) s) r WHERE rank <= CASE WHEN whole THEN 5 ELSE 8 END"""


def _matrix_tables(spark, sf_dir):
    V.register(spark, sf_dir, "orders", "embeddings")
    stated = F.map_filter(F.create_map(*[x for f in _FIELDS for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    return spark.sql(_MATRIX), spark.sql(_STATED).select("qid", "qvec", stated.alias("conditions"))


@query("matrix_route", _MATRIX_SQL)
def matrix_route(spark, sf_dir):
    chunks, asked = _matrix_tables(spark, sf_dir)
    return routes.matrix_hits(chunks, asked, 8).select("qid", "source_file", "sequence_id", "score", "rank")


_FLAGS_SQL = f"""WITH c AS ({_MATRIX}), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_file || '||' || sequence_id) AS r FROM (SELECT qid, source_file, sequence_id, section, round(list_inner_product(qvec::DOUBLE[], vec::DOUBLE[]), 4) AS score FROM ({_STATED}) q JOIN c ON table_type = 'feature_flags') s) x WHERE r <= 50),
 e AS (SELECT qid, source_file, sequence_id FROM (SELECT t.qid, c.source_file, c.sequence_id, row_number() OVER (PARTITION BY t.qid, c.source_file, c.section ORDER BY c.sequence_id) AS r FROM c JOIN (SELECT DISTINCT qid, source_file, section FROM h) t ON c.source_file = t.source_file AND c.section = t.section) x WHERE r <= 300)
SELECT coalesce(h.qid, e.qid) AS qid, coalesce(h.source_file, e.source_file) AS source_file, coalesce(h.sequence_id, e.sequence_id) AS sequence_id, coalesce(score, 0.0) AS score FROM h FULL JOIN e ON h.qid = e.qid AND h.source_file = e.source_file AND h.sequence_id = e.sequence_id"""


@query("flag_route", _FLAGS_SQL)
def flag_route(spark, sf_dir):
    chunks, asked = _matrix_tables(spark, sf_dir)
    return routes.flag_hits(chunks, asked.select("qid", "qvec")).select("qid", "source_file", "sequence_id", "score")


@query("validated_values", f"""SELECT sequence_id AS qid, list_sort(list_filter([CASE WHEN sequence_id % 2 = 0 THEN 'energy_widget' ELSE '' END, CASE WHEN sequence_id % 3 <> 0 THEN 'carbon_widget' ELSE '' END], lambda x: x <> '')) AS missing FROM ({_MATRIX}) m""")
def validated_values(spark, sf_dir):
    """Answers that hold one value of their row, the other, both (in another case) or none."""
    rows, _ = _matrix_tables(spark, sf_dir)
    said = F.concat(F.lit("It shows "), F.when(F.col("sequence_id") % 2 != 0, F.upper("energy_widget")).otherwise(""), F.lit(" and "), F.when(F.col("sequence_id") % 3 == 0, F.lower("carbon_widget")).otherwise(""))
    return routes.value_mismatches(rows, rows.select(F.col("sequence_id").alias("qid"), "source_file", "sequence_id", said.alias("answer")))
