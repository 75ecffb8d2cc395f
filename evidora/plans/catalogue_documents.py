"""Queries on paginated documents: headings, sections, tables, neighbourhoods and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, vocab
from ..functions import text as T
from ..operators import context, documents, tables
from . import duck as D
from . import views as V

QUERIES: dict = {}
ORDER = ["pdf_page_number"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _fill_sql(pages: str) -> str:
    return f"""e AS ({pages}), p AS (SELECT *, row_number() OVER w AS pos FROM e WINDOW w AS (PARTITION BY source_file ORDER BY pdf_page_number)),
 f AS (SELECT *, last_value(h1_here IGNORE NULLS) OVER u AS h1, last_value(CASE WHEN h1_here IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS p1, last_value(h2_here IGNORE NULLS) OVER u AS hh2, last_value(CASE WHEN h2_here IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS p2 FROM p WINDOW u AS (PARTITION BY source_file ORDER BY pdf_page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, CASE WHEN p1 IS NULL OR p2 >= p1 THEN hh2 END AS h2 FROM f)"""


def _filled(spark, sf_dir, pages: str = V.WHOLE_FILES) -> DataFrame:
    return documents.heading_fill(V.view(spark, sf_dir, pages), ORDER, blocks=pages == V.WHOLE_FILES)


@query("heading_ffill", f"WITH {_fill_sql(V.WHOLE_FILES)} SELECT source_file, pdf_page_number, h1, h2 FROM h")
def heading_ffill(spark, sf_dir):
    return _filled(spark, sf_dir).select("source_file", "pdf_page_number", "h1", "h2")


def _ends(x: str, side: str) -> str:
    s = D.strip(x)
    return f"coalesce(CASE WHEN length({s}) > 400 THEN {D.strip(f'{side}({s}, 400)')} ELSE {s} END, '')"


@query("snippet_prev_next", f"""SELECT source_file, pdf_page_number, {_ends('a', 'right')} AS preceding_text, {_ends('z', 'left')} AS following_text FROM (SELECT source_file, pdf_page_number, last_value(CASE WHEN element_type = 'TEXT' THEN content END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 first_value(CASE WHEN element_type = 'TEXT' THEN content END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM ({V.WHOLE_FILES}) e WINDOW w AS (PARTITION BY source_file ORDER BY pdf_page_number)) x""")
def snippet_prev_next(spark, sf_dir):
    return documents.snippets(V.view(spark, sf_dir, V.WHOLE_FILES), ORDER).select("source_file", "pdf_page_number", "preceding_text", "following_text")


def _islands_sql(pages: str) -> str:
    return f"""WITH {_fill_sql(pages)}, s AS (SELECT *, coalesce(nullif(h2, ''), nullif(h1, ''), '') AS section FROM h), l AS (SELECT *, CASE WHEN element_type = 'TEXT' AND lag(element_type) OVER w = 'TEXT' AND section = lag(section) OVER w AND section <> '' THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY source_file ORDER BY pdf_page_number)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_file ORDER BY pdf_page_number) AS island FROM l), g AS (SELECT source_file, CAST(island AS BIGINT) AS island, any_value(section) AS section, any_value(element_type) AS element_type, min(pdf_page_number) AS page, max(pdf_page_number) AS page_end, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY pdf_page_number) AS content FROM i GROUP BY source_file, island)"""


def _sections(spark, sf_dir, pages: str = V.WHOLE_FILES) -> DataFrame:
    return documents.merge_sections(_filled(spark, sf_dir, pages), ORDER, blocks=pages == V.WHOLE_FILES)


@query("merge_sections", _islands_sql(V.ELEMENTS) + " SELECT source_file, island, section, element_type, page, page_end, n, md5(content) AS digest FROM g")
def merge_sections(spark, sf_dir):
    return _sections(spark, sf_dir, V.ELEMENTS).select("source_file", "island", "section", "element_type", "page", "page_end", "n", F.md5("content").alias("digest"))


@query("sequence_ids", _islands_sql(V.WHOLE_FILES) + " SELECT source_file, island, CAST(row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN element_type = 'TEXT' THEN 0 ELSE 1 END, island) AS INTEGER) AS sequence_id FROM g")
def sequence_ids(spark, sf_dir):
    return documents.sequence_ids(_sections(spark, sf_dir), ["island"]).select("source_file", "island", "sequence_id")


@query("section_chunks")
def section_chunks(spark, sf_dir):
    return documents.section_chunks(_sections(spark, sf_dir, V.ELEMENTS)).select("source_file", "island", "part", "chunk_type", "page_info", "display")


@query("page_split")
def page_split(spark, sf_dir):
    pages = V.view(spark, sf_dir, V.ELEMENTS).groupBy("source_file", F.floor((F.col("pdf_page_number") - 1) / 5).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page_number", "content"))), lambda x: x["content"]), "\n\n").alias("markdown"))
    return documents.split_pages(pages)


@query("asset_counts_pivot", _islands_sql(V.WHOLE_FILES) + " SELECT source_file, count(*) FILTER (WHERE element_type = 'TEXT') AS n_text, count(*) FILTER (WHERE element_type = 'TABLE') AS n_table, max(page_end) AS pages FROM g GROUP BY source_file")
def asset_counts_pivot(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("source_file").agg(F.count_if(F.col("element_type") == "TEXT").alias("n_text"), F.count_if(F.col("element_type") == "TABLE").alias("n_table"), F.max("page_end").alias("pages"))


_LINES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Intro ........... 12' || chr(10) || '.........' || chr(10) || '7' WHEN 1 THEN 'Guide' || chr(10) || '12' WHEN 2 THEN 'Cancel | Compute | Workspace' || chr(10) || '| a | b |' ELSE text END AS content FROM documents"
_L = f"list_filter(list_transform(string_split(content, chr(10)), lambda x: {D.strip('x')}), lambda x: x <> '')"


@query("toc_filter", f"SELECT doc_id, CASE WHEN len({_L}) = 0 THEN TRUE ELSE len(list_filter({_L}, lambda x: length(x) - length(regexp_replace(x, '[.·…]', '', 'g')) > length(x) * 0.4 OR regexp_matches(x, {D.text(documents.TOC_LINE)}))) / len({_L})::DOUBLE > 0.7 END AS is_toc FROM ({_LINES}) l")
def toc_filter(spark, sf_dir):
    V.register(spark, sf_dir, "documents")
    return spark.sql(_LINES).select("doc_id", documents.is_toc(F.col("content")).alias("is_toc"))


@query("page_header_filter", f"SELECT doc_id, len(list_filter({_L}, lambda x: NOT regexp_matches(x, '(?i)^(guide|\\d{{1,3}})$'))) = 0 AS is_header FROM ({_LINES}) l")
def page_header_filter(spark, sf_dir):
    V.register(spark, sf_dir, "documents")
    return spark.sql(_LINES).select("doc_id", documents.is_page_header(F.col("content"), ["guide"]).alias("is_header"))


@query("ui_table_filter", f"SELECT doc_id, len({_L}) >= 2 AND ({D.hits('lower(content)', vocab.SCREENSHOT_WORDS)} >= 2 OR {D.hits('lower(content)', vocab.FILE_BROWSER_WORDS)} >= 2) AS is_screenshot FROM ({_LINES}) l")
def ui_table_filter(spark, sf_dir):
    V.register(spark, sf_dir, "documents")
    return spark.sql(_LINES).select("doc_id", documents.is_screenshot_table(F.col("content")).alias("is_screenshot"))


@query("slugs", "SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}_\\s\\-]', '', 'g'), '[\\s_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80) AS slug FROM documents")
def slugs(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("section_numbers", "SELECT doc_id, regexp_extract(t, '^(\\d[\\d.]*)\\s+(.*)', 1) AS number, CASE WHEN regexp_matches(t, '^\\d[\\d.]*\\s+') THEN regexp_extract(t, '^(\\d[\\d.]*)\\s+(.*)', 2) ELSE t END AS title FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 + 1 AS VARCHAR) || '.' || CAST(doc_id % 5 AS VARCHAR) || ' Setup of ' || lang ELSE 'Setup of ' || lang END AS t FROM documents) x")
def section_numbers(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string"), F.lit(" Setup of "), "lang")).otherwise(F.concat(F.lit("Setup of "), "lang"))
    return d.select("doc_id", T.section_id(t).alias("number"), T.section_title(t).alias("title"))


_TABLES = f"SELECT source_file, pdf_page_number AS page, content FROM ({V.ELEMENTS}) e WHERE element_type = 'TABLE'"
_ROW = "list_transform(string_split(regexp_replace(x, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c))"


@query("table_parse", f"SELECT source_file, page, array_to_string(list_transform({_ROW.replace('(x,', '(string_split(content, chr(10))[1],')}, lambda h: lower(h)), '|') AS headers, len(string_split(content, chr(10))) - 2 AS n_rows, array_to_string({_ROW.replace('(x,', '(string_split(content, chr(10))[3],')}, '|') AS first_row FROM ({_TABLES}) t")
def table_parse(spark, sf_dir):
    t = tables.parse_table(V.view(spark, sf_dir, _TABLES), "content")
    return t.select("source_file", "page", tables.signature(F.col("headers")).alias("headers"), F.size("rows").cast("bigint").alias("n_rows"), F.array_join(F.element_at("rows", 1), "|").alias("first_row"))


def _fragments(spark, sf_dir) -> DataFrame:
    f = V.view(spark, sf_dir, V.FRAGMENTS).withColumn("headers", F.split("headers", ";"))
    rows = F.array(F.transform("headers", lambda h: F.concat(h, F.col("frag").cast("string"))), F.transform("headers", lambda h: F.concat(F.lit("x"), F.col("page").cast("string"))))
    return f.withColumn("table_type", classify.table_type(F.col("headers"), F.col("section"))).withColumn("rows", rows)


_TYPE = f"CASE WHEN {D.has_any('lower(section)', vocab.MATRIX_SECTION_WORDS)} OR {D.hits('lower(replace(headers, chr(59), chr(32)))', vocab.MATRIX_HEADER_WORDS)} >= 2 THEN 'conditional_matrix' WHEN {D.has_any('lower(section)', vocab.FLAG_SECTION_WORDS)} OR {D.hits('lower(replace(headers, chr(59), chr(32)))', vocab.FLAG_HEADER_WORDS)} >= 2 THEN 'feature_flags' ELSE 'generic_table' END"
_CHAIN = f"""WITH fr AS (SELECT *, {_TYPE} AS table_type FROM ({V.FRAGMENTS}) f), pr AS (SELECT *, lag(page) OVER w AS p0, lag(headers) OVER w AS h0, lag(cue) OVER w AS c0, lag(table_type) OVER w AS t0 FROM fr WINDOW w AS (PARTITION BY source_file ORDER BY page, frag)),
 li AS (SELECT *, string_split(h0, ';') AS a, string_split(headers, ';') AS b FROM pr), sg AS (SELECT *, CASE WHEN h0 = headers THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS j, regexp_matches(c0, {D.text(tables.CUE)}) AS cu FROM li),
 cf AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN round(greatest(0.0, least(1.0, (0.20::DOUBLE * CASE page - p0 WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.0::DOUBLE ELSE -1.5::DOUBLE END + 0.35::DOUBLE * j + 0.15::DOUBLE * CASE WHEN len(a) = len(b) THEN 1 ELSE 0 END + 0.10::DOUBLE + CASE WHEN cu THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN t0 = table_type THEN 0.05::DOUBLE ELSE 0 END)
  / (0.80::DOUBLE + CASE WHEN cu THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN t0 = table_type THEN 0.05::DOUBLE ELSE 0 END))), 4) END AS confidence FROM sg),
 cn AS (SELECT *, CAST(sum(CASE WHEN coalesce(confidence >= 0.45, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY source_file ORDER BY page, frag) AS INTEGER) AS chain FROM cf)"""


@query("table_continuation", _CHAIN + " SELECT source_file, frag, table_type, confidence, chain FROM cn")
def table_continuation(spark, sf_dir):
    return tables.chains(_fragments(spark, sf_dir)).select("source_file", "frag", "table_type", "confidence", "chain")


@query("full_tables", _CHAIN + " SELECT source_file, chain, min(page) AS page_start, max(page) AS page_end, count(*) AS n_fragments, CAST(2 * count(*) AS INTEGER) AS n_rows, 'tbl_' || substr(sha256(source_file || '||' || CAST(chain AS VARCHAR)), 1, 16) AS group_id FROM cn GROUP BY source_file, chain")
def full_tables(spark, sf_dir):
    return tables.whole_tables(tables.chains(_fragments(spark, sf_dir))).select("source_file", "chain", "page_start", "page_end", "n_fragments", "n_rows", "group_id")


@query("full_table_rows", _CHAIN + ", nb AS (SELECT *, row_number() OVER (PARTITION BY source_file, chain ORDER BY page, frag) - 1 AS fi FROM cn) SELECT source_file, chain, page, CAST(fi AS INTEGER) AS fragment_index, CAST(i AS INTEGER) AS fragment_row_index, CAST(2 * fi + i AS INTEGER) AS row_index FROM nb CROSS JOIN (VALUES (0), (1)) AS t(i)")
def full_table_rows(spark, sf_dir):
    return tables.numbered_rows(tables.chains(_fragments(spark, sf_dir))).select("source_file", "chain", "page", "fragment_index", "fragment_row_index", "row_index")


@query("header_jaccard", f"SELECT x.source_file, x.frag AS a, y.frag AS b, round(len(list_intersect(list_distinct(string_split(x.headers, ';')), list_distinct(string_split(y.headers, ';'))))::DOUBLE / len(list_distinct(list_concat(string_split(x.headers, ';'), string_split(y.headers, ';')))), 4) AS j FROM ({V.FRAGMENTS}) x JOIN ({V.FRAGMENTS}) y ON x.source_file = y.source_file AND x.frag < y.frag")
def header_jaccard(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    a, b = f.select("source_file", F.col("frag").alias("a"), F.col("headers").alias("ha")), f.select("source_file", F.col("frag").alias("b"), F.col("headers").alias("hb"))
    return a.join(b, "source_file").where("a < b").select("source_file", "a", "b", F.round(tables.header_likeness(F.col("ha"), F.col("hb")), 4).alias("j"))


@query("table_chunks")
def table_chunks(spark, sf_dir):
    t = tables.parse_table(V.view(spark, sf_dir, _TABLES), "content").withColumn("section", F.lit("Feature flags")).withColumn("markdown", F.col("content"))
    return tables.table_chunks(t)


@query("flag_rows", f"SELECT source_file, page, lower('f' || doc_id) AS description, lang AS product FROM (SELECT *, source || '-' || CAST(CAST(floor(doc_id / 10000.0) AS BIGINT) AS STRING) AS source_file, CAST(floor(doc_id / 20.0) AS BIGINT) + 1 AS page FROM documents WHERE floor(doc_id / 20.0) % 5 = 4) x")
def flag_rows(spark, sf_dir):
    t = tables.parse_table(V.view(spark, sf_dir, _TABLES), "content").select("source_file", "page", "headers", F.explode("rows").alias("cells"))
    r = tables.flag_row(F.col("headers"), F.col("cells"))
    return t.select("source_file", "page", F.element_at("cells", 1).alias("description"), r["product"].alias("product"))


_STATES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Enabl ed' WHEN 1 THEN 'disabled' ELSE '' END AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'Disabled' ELSE '' END AS c, CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'Disabled' ELSE '' END AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'NO' ELSE '' END AS o FROM orders"
_NAMED = "CASE id % 3 WHEN 0 THEN 'Enabled' WHEN 1 THEN 'Disabled' END AS un, CASE WHEN c <> '' THEN c END AS cn, CASE e WHEN 'yes' THEN 'Yes' WHEN 'Disabled' THEN 'No' END AS en, CASE WHEN o <> '' THEN 'No' END AS onn"


@query("widget_rows", f"""WITH n AS (SELECT id, {_NAMED} FROM ({_STATES}) s) SELECT id, CASE WHEN coalesce(un, cn, en, onn) IS NULL THEN '' ELSE 'widget_' || concat_ws('_', 'user_' || lower(un), 'coexist_' || lower(cn), 'energy_' || lower(en), 'eo_' || lower(onn)) END AS row_id,
 concat_ws(' | ', 'User ' || un, 'Coexist ' || cn, 'Energy Default ' || en, 'EO Default ' || onn) AS row_label FROM n""")
def widget_rows(spark, sf_dir):
    """Ids and labels of matrix rows with the states of every order, broken spellings repaired."""
    V.register(spark, sf_dir, "orders")
    headers = F.array(*map(F.lit, ["User Feature Flag", "Coexist Flag", "Energy Default Baseline", "EO Default"]))
    r = tables.matrix_row(headers, F.array("u", "c", "e", "o"))
    return spark.sql(_STATES).select("id", r["row_id"].alias("row_id"), r["row_label"].alias("row_label"))


def _chunks_sql(pages: str) -> str:
    return f"SELECT source_file, CAST(pdf_page_number AS INTEGER) AS sequence_id, CASE WHEN element_type = 'TEXT' THEN 'TEXT' ELSE 'TABLE_ROW' END AS asset_type, 'S' || CAST(CAST(floor(pdf_page_number / 7.0) AS BIGINT) AS STRING) AS section FROM ({pages}) e"


def _hits_sql(chunks: str) -> str:
    return f"SELECT * FROM ({chunks}) c WHERE sequence_id % 20 = 0"


_CHUNKS = _chunks_sql(V.ELEMENTS)
_HITS = _hits_sql(_CHUNKS)
_WHOLE_CHUNKS = _chunks_sql(V.WHOLE_FILES)
_WHOLE_HITS = _hits_sql(_WHOLE_CHUNKS)


def _chunks(spark, sf_dir, chunks: str = _CHUNKS) -> tuple[DataFrame, DataFrame]:
    return V.view(spark, sf_dir, chunks), V.view(spark, sf_dir, _hits_sql(chunks))


@query("seq_neighbours_pm3", f"SELECT DISTINCT c.source_file, c.sequence_id FROM ({_WHOLE_CHUNKS}) c JOIN ({_WHOLE_HITS}) h ON c.source_file = h.source_file AND c.sequence_id BETWEEN h.sequence_id - 3 AND h.sequence_id + 3 WHERE c.sequence_id % 20 <> 0")
def seq_neighbours_pm3(spark, sf_dir):
    return context.neighbours(*_chunks(spark, sf_dir, _WHOLE_CHUNKS)).select("source_file", "sequence_id").distinct()


@query("sequence_span", f"SELECT source_file, sequence_id FROM (SELECT c.*, row_number() OVER (PARTITION BY c.source_file ORDER BY sequence_id) AS r FROM ({_CHUNKS}) c JOIN (SELECT source_file, min(sequence_id) - 5 AS a, max(sequence_id) + 5 AS z FROM ({_HITS}) h GROUP BY source_file) s ON c.source_file = s.source_file AND sequence_id BETWEEN a AND z WHERE asset_type = 'TEXT') x WHERE r <= 50 AND sequence_id % 20 <> 0")
def sequence_span(spark, sf_dir):
    return context.span(*_chunks(spark, sf_dir)).select("source_file", "sequence_id")


@query("section_siblings", f"SELECT source_file, sequence_id FROM (SELECT c.*, row_number() OVER (PARTITION BY source_file, section ORDER BY sequence_id) AS r FROM ({_CHUNKS}) c SEMI JOIN ({_HITS}) h USING (source_file, section) WHERE asset_type = 'TEXT') x WHERE r <= 100 AND sequence_id % 20 <> 0")
def section_siblings(spark, sf_dir):
    return context.section_siblings(*_chunks(spark, sf_dir)).select("source_file", "sequence_id")


@query("table_siblings", f"SELECT source_file, sequence_id FROM (SELECT c.*, row_number() OVER (PARTITION BY source_file, section ORDER BY sequence_id) AS r FROM ({_CHUNKS}) c SEMI JOIN (SELECT * FROM ({_HITS}) q WHERE asset_type = 'TABLE_ROW') h USING (source_file, section) WHERE asset_type = 'TABLE_ROW') x WHERE r <= 300 AND sequence_id % 20 <> 0")
def table_siblings(spark, sf_dir):
    return context.table_siblings(*_chunks(spark, sf_dir)).select("source_file", "sequence_id")


@query("context_union", f"SELECT DISTINCT c.source_file, c.sequence_id, c.sequence_id % 20 <> 0 AS is_extra FROM ({_WHOLE_CHUNKS}) c JOIN ({_WHOLE_HITS}) h ON c.source_file = h.source_file AND c.sequence_id BETWEEN h.sequence_id - 3 AND h.sequence_id + 3")
def context_union(spark, sf_dir):
    chunks, hits = _chunks(spark, sf_dir, _WHOLE_CHUNKS)
    return context.expand(chunks, hits, context.neighbours(chunks, hits)).select("source_file", "sequence_id", (F.col("side") == 1).alias("is_extra")).distinct()


_CAPPED = f"SELECT qid, CASE qid WHEN 1 THEN 'text_section' WHEN 2 THEN 'hybrid' ELSE 'table_full' END AS route, source_file, sequence_id, CASE WHEN sequence_id % 13 = 0 THEN 'TABLE_FULL' ELSE asset_type END AS asset_type, CAST((sequence_id * 37 + qid * 11) % 101 AS DOUBLE) AS score FROM ({_CHUNKS}) c CROSS JOIN (VALUES (1), (2), (3)) AS t(qid)"


@query("smart_cap", f"""WITH k AS (SELECT *, CASE WHEN asset_type = 'TEXT' THEN 'text' WHEN asset_type = 'TABLE_FULL' THEN 'full' ELSE 'rows' END AS kind FROM ({_CAPPED}) c), t AS (SELECT *, count(*) FILTER (WHERE kind <> 'text') OVER (PARTITION BY qid) AS nt, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, source_file, sequence_id) AS place FROM k),
 s AS (SELECT *, CASE kind WHEN 'text' THEN CASE route WHEN 'text_section' THEN 6 WHEN 'hybrid' THEN 6 ELSE greatest(2, 5 - nt) END WHEN 'rows' THEN CASE route WHEN 'text_section' THEN 2 WHEN 'hybrid' THEN 2 ELSE 1000000 END ELSE CASE WHEN route IN ('text_section', 'hybrid') THEN 0 ELSE 1000000 END END AS slots FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN route = 'text_section' AND kind = 'text' THEN 0 WHEN kind = 'rows' THEN 1 WHEN kind = 'full' THEN 2 ELSE 3 END, place) AS rr FROM s WHERE place <= slots) SELECT qid, source_file, sequence_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY sequence_id, source_file) AS INTEGER) AS reading_order FROM r WHERE rr <= 50""")
def smart_cap(spark, sf_dir):
    return context.smart_cap(V.view(spark, sf_dir, _CAPPED)).select("qid", "source_file", "sequence_id", "reading_order")
