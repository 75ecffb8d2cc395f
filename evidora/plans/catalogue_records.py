"""Queries on records: cleaning, classification, normalisation, chunks and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, ids, vocab
from ..functions import text as T
from ..operators import records, upsert
from ..sources import files
from . import duck as D
from . import views as V

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _masked(name: str, pattern: str, mark: str, flags: str = "g") -> None:
    sql = f"SELECT doc_id, regexp_replace(text, {D.text(pattern)}, {D.text(mark)}, '{flags}') AS masked FROM documents" if pattern else None

    @query(f"mask_{name}", sql)
    def run(spark, sf_dir):
        return V.table(spark, sf_dir, "documents").select("doc_id", T.mask(F.col("text"), name).alias("masked"))


for _n, _, _p, _m in vocab.MASKS:
    if _n == "phone":  # look-behind has no form in the oracle's expressions
        _masked(_n, "", _m)
    elif _n == "token":
        _masked(_n, r"\b(?:bearer\s+)?[A-Za-z0-9_\-]{32,}\b", _m, "gi")
    else:
        _masked(_n, _p, _m)


@query("clean_text")
def clean_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("strip_markup", f"""SELECT doc_id, {D.collapse("regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[*_#>`~]{1,3}', ' ', 'g'), '\\[([^\\]|]+)\\|[^\\]]+\\]', '\\1', 'g'), '\\{[a-z]+(:[^}]*)?\\}', ' ', 'g')".join(["regexp_replace(", ", '(?i)!\\[[^\\]]*\\]\\([^)]*\\)|!\\[[^\\]]*\\]|![^!\\n]+\\.(?:png|jpg|jpeg|gif)[^!\\n]*!', ' ', 'g')"]))} AS cleaned FROM documents""")
def strip_markup(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text"), masked=False).alias("cleaned"))


@query("tokenize_counts", f"SELECT doc_id, len({D.tokens('text')}) AS n_tokens, len(list_distinct({D.tokens('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query("truncate_texts", f"SELECT doc_id, {D.truncate('text', 220)} AS short FROM documents")
def truncate_texts(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 220).alias("short"))


@query("extract_keys", f"SELECT issue_key, array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(upper(description), '\\b([A-Z][A-Z0-9]+-\\d{{2,}})\\b', 1), lambda k: k))), lambda k: k), ',') AS keys, split_part(issue_key, '-', 1) AS project FROM ({V.DEFECTS}) d")
def extract_keys(spark, sf_dir):
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", F.array_join(F.array_sort(T.issue_keys(F.col("description"))), ",").alias("keys"), T.project_of(F.col("issue_key")).alias("project"))


_FIXED = f"(list_contains({D.texts(vocab.FIXED_STATUSES)}, lower(status)) OR list_contains({D.texts(vocab.FIXED_RESOLUTIONS)}, lower(resolution)))"
_CANCELLED = f"(list_contains({D.texts(vocab.CANCELLED_STATUSES)}, lower(status)) OR list_contains({D.texts(vocab.CANCELLED_RESOLUTIONS)}, lower(resolution)))"


@query("classify_status", f"SELECT issue_key, {_FIXED} AS is_fixed, {_CANCELLED} AS is_cancelled FROM ({V.DEFECTS}) d")
def classify_status(spark, sf_dir):
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", classify.is_fixed(F.col("status"), F.col("resolution")).alias("is_fixed"), classify.is_cancelled(F.col("status"), F.col("resolution")).alias("is_cancelled"))


_BLOB = "description"


@query("classify_pattern", f"SELECT issue_key, CASE WHEN p <> '' THEN p ELSE 'Unknown' END AS fix_pattern, CASE WHEN t <> '' THEN t ELSE 'unknown' END AS defect_type FROM (SELECT issue_key, {D.category('b', vocab.FIX_PATTERN_CUES)} AS p, {D.category('b', vocab.DEFECT_TYPE_CUES)} AS t FROM (SELECT issue_key, {_BLOB} AS b FROM ({V.DEFECTS}) d) x) y")
def classify_pattern(spark, sf_dir):
    blob = F.col("description")
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", classify.fix_pattern(blob).alias("fix_pattern"), classify.defect_type(blob).alias("defect_type"))


_ERRORS = "(?i)(" + "|".join(vocab.ERROR_PATTERNS) + ")"
_FOUND = f"list_transform(regexp_extract_all({_BLOB}, {D.text(_ERRORS)}, 1), lambda x: trim(x))"


@query("error_signature", f"SELECT issue_key, array_to_string(list_filter({_FOUND}, lambda x, i: list_position(list_transform({_FOUND}, lambda y: lower(y)), lower(x)) = i)[1:6], '; ') AS signature FROM ({V.DEFECTS}) d")
def error_signature(spark, sf_dir):
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", T.error_signature(F.col("description")).alias("signature"))


@query("first_sentence_with_cue")
def first_sentence_with_cue(spark, sf_dir):
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", T.first_sentence_with(F.col("description"), vocab.FIX_CUES + vocab.ROOT_CAUSE_CUES).alias("sentence"))


@query("quality_score", f"""SELECT issue_key, greatest(0.0, least(1.0, round(CASE WHEN summary <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN length(description) > 40 THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN len(components) > 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN {_FIXED} THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN {_CANCELLED} THEN 0.20::DOUBLE ELSE 0 END, 3))) AS quality FROM ({V.DEFECTS}) d""")
def quality_score(spark, sf_dir):
    d, none = V.view(spark, sf_dir, V.DEFECTS), F.lit("")
    fixed, cancelled = classify.is_fixed(F.col("status"), F.col("resolution")), classify.is_cancelled(F.col("status"), F.col("resolution"))
    return d.select("issue_key", classify.quality(F.col("summary"), F.col("description"), F.lit(False), none, none, F.size("components") > 0, none, fixed, cancelled).alias("quality"))


@query("stable_ids", "SELECT doc_id, 'doc_' || substr(sha256(source || '||' || CAST(doc_id AS VARCHAR)), 1, 16) AS stable, regexp_replace(substr(sha256(source || '||' || text), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point, source || '||' || CAST(doc_id AS VARCHAR) AS chunk_key FROM documents")
def stable_ids(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.stable_id(F.col("source"), F.col("doc_id"), prefix="doc_").alias("stable"), ids.point_id(F.col("source"), F.col("text")).alias("point"), ids.chunk_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_key"))


_CLEAN_COMMENTS = f"SELECT issue_key, pos, author, {D.strip('body')} AS body FROM ({V.COMMENTS}) c WHERE {D.strip('body')} <> ''"


@query("comments_join", f"SELECT d.issue_key, count(c.issue_key) AS n_comments, coalesce(string_agg(c.author, ',' ORDER BY c.pos, c.author), '') AS authors FROM ({V.DEFECTS}) d LEFT JOIN ({_CLEAN_COMMENTS}) c ON d.issue_key = c.issue_key GROUP BY d.issue_key")
def comments_join(spark, sf_dir):
    d = records.with_comments(V.view(spark, sf_dir, V.DEFECTS), V.view(spark, sf_dir, V.COMMENTS))
    return d.select("issue_key", F.size("comments").cast("bigint").alias("n_comments"), F.array_join(F.transform("comments", lambda x: x["author"]), ",").alias("authors"))


_HINTS = "SELECT * FROM (VALUES (1, 'model integration', 'EVD-1001;EVD-1003'), (2, 'ui state', 'EVD-1003;EVD-1005'), (3, 'data rules', 'EVD-1005;EVD-1008')) AS t(pos, pattern, keys)"


@query("hint_left_join", f"SELECT d.issue_key, h.hint FROM ({V.DEFECTS}) d LEFT JOIN (SELECT issue_key, arg_min(pattern, pos) AS hint FROM (SELECT pos, pattern, unnest(string_split(keys, ';')) AS issue_key FROM ({_HINTS}) q) e GROUP BY issue_key) h ON d.issue_key = h.issue_key")
def hint_left_join(spark, sf_dir):
    hints = spark.sql(_HINTS).withColumn("keys", F.split("keys", ";"))
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key").join(records.first_hints(hints), "issue_key", "left")


def all_records(spark, sf_dir):
    """Records of the view with its comments."""
    return records.normalize(records.with_comments(V.view(spark, sf_dir, V.DEFECTS), V.view(spark, sf_dir, V.COMMENTS)))


@query("defect_normalize")
def defect_normalize(spark, sf_dir):
    return all_records(spark, sf_dir).drop("comments", "doc_id")


@query("failure_area", f"SELECT issue_key, array_to_string(components, ', ') || ' | ' || product || ' | ' || team || ' | ' || environment AS failure_area, {_FIXED} AS is_fixed FROM ({V.DEFECTS}) d WHERE NOT {_CANCELLED}")
def failure_area(spark, sf_dir):
    d = records.normalize(V.view(spark, sf_dir, V.DEFECTS), drop_cancelled=True)
    return d.select("issue_key", "failure_area", "is_fixed")


@query("record_statistics", f"SELECT count(*) AS n, count(*) FILTER (WHERE {_FIXED}) AS n_fixed FROM ({V.DEFECTS}) d")
def record_statistics(spark, sf_dir):
    return records.statistics(all_records(spark, sf_dir)).select("n", "n_fixed")


@query("issue_chunks")
def issue_chunks(spark, sf_dir):
    return records.chunks(all_records(spark, sf_dir)).select("chunk_id", "issue_key", "chunk_type", "text", "fix_pattern", "quality_score")


@query("full_context_heads", f"SELECT issue_key || '::full_context_chunk' AS chunk_id, '[' || issue_key || ']' AS head FROM ({V.DEFECTS}) d")
def full_context_heads(spark, sf_dir):
    c = records.chunks(all_records(spark, sf_dir)).where("chunk_type = 'full_context_chunk'")
    return c.select("chunk_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("head"))


@query("csv_flatten", f"SELECT issue_key, array_to_string(components, '; ') AS components, array_to_string(labels, '; ') AS labels FROM ({V.DEFECTS}) d")
def csv_flatten(spark, sf_dir):
    return files.flat(V.view(spark, sf_dir, V.DEFECTS).select("issue_key", "components", "labels"))


_RAW = "SELECT event_id, '{\"key\":\"K-' || CAST(event_id AS STRING) || '\",\"fields\":{\"status\":{\"name\":\" ' || event_type || ' \"},\"labels\":[\"a\",\"\",\"' || event_type || '\"],\"assignee\":null,\"priority\":\"P' || CAST(event_id % 3 AS STRING) || '\"}}' AS raw FROM events"


@query("raw_field_access", "SELECT 'K-' || CAST(event_id AS VARCHAR) AS issue_key, event_type AS status, 'P' || CAST(event_id % 3 AS VARCHAR) AS priority, 'a,' || event_type AS labels, 'Unassigned' AS assignee FROM events")
def raw_field_access(spark, sf_dir):
    V.register(spark, sf_dir, "events")
    found = files.raw_issues(spark.sql(_RAW))
    return found.select("issue_key", "status", "priority", F.array_join("labels", ",").alias("labels"), "assignee")


@query("rich_text_flatten")
def rich_text_flatten(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("content")))
    return d.select("conv_id", "turn", files.rich_text(tree).alias("plain"))


_V1 = "SELECT event_id % 500 AS k, event_id AS version, event_type AS body FROM events WHERE event_id % 2 = 0"
_V2 = "SELECT event_id % 700 AS k, event_id AS version, event_type AS body FROM events WHERE event_id % 2 = 1"


@query("chunk_upsert", f"WITH a AS ({_V1}), b AS ({_V2}), la AS (SELECT k, max(version) AS version, arg_max(body, version) AS body FROM a GROUP BY k), lb AS (SELECT k, max(version) AS version, arg_max(body, version) AS body FROM b GROUP BY k) SELECT * FROM la WHERE k NOT IN (SELECT k FROM lb) UNION ALL SELECT * FROM lb")
def chunk_upsert(spark, sf_dir):
    V.register(spark, sf_dir, "events")
    old, new = (upsert.latest(spark.sql(q), ["k"], "version") for q in (_V1, _V2))
    return upsert.upsert(old, new, ["k"])


@query("delete_by_key", f"SELECT issue_key FROM ({V.DEFECTS}) d WHERE issue_key NOT IN (SELECT 'EVD-' || CAST(1000 + conv_id AS VARCHAR) FROM conversations)")
def delete_by_key(spark, sf_dir):
    return upsert.delete(V.view(spark, sf_dir, V.DEFECTS), V.view(spark, sf_dir, V.COMMENTS), ["issue_key"]).select("issue_key")


@query("distinct_sources", "SELECT DISTINCT source AS source_file FROM documents WHERE source <> ''")
def distinct_sources(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").where("source <> ''").select(F.col("source").alias("source_file")).distinct()


@query("payload_projection", "SELECT doc_id, coalesce(nullif(text, ''), source) AS display FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 4000")
def payload_projection(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").where("lang = 'en' AND n_chars BETWEEN 100 AND 4000")
    return d.select("doc_id", T.first_nonempty(F.col("text"), F.col("source")).alias("display"))


@query("sla_breach", f"SELECT o_orderkey, band, target_days, is_open AND date_diff('day', created, DATE '2001-08-02') > target_days AS breached FROM ({V.SLA}) s")
def sla_breach(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days, late = classify.sla_days(F.col("o_orderpriority")), F.date_diff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", classify.price_band(F.col("o_totalprice")).alias("band"), days.alias("target_days"), ((F.col("o_orderstatus") == "O") & (late > days)).alias("breached"))


@query("sla_by_segment", f"SELECT c_mktsegment, band, count(*) AS n, count(*) FILTER (WHERE is_open) AS n_open FROM ({V.SLA}) s JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, band")
def sla_by_segment(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    s = V.view(spark, sf_dir, V.SLA)
    return s.join(c, s["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "band").agg(F.count("*").alias("n"), F.count_if("is_open").alias("n_open"))


@query("status_tones", f"SELECT issue_key, CASE WHEN regexp_matches(lower(status), 'fixed|done|closed|resolved|verified|completed') THEN 'good' WHEN regexp_matches(lower(status), 'cancel|reject|duplicate|won') THEN 'muted' WHEN regexp_matches(lower(status), 'progress|review|test') THEN 'active' ELSE 'open' END AS tone FROM ({V.DEFECTS}) d")
def status_tones(spark, sf_dir):
    return V.view(spark, sf_dir, V.DEFECTS).select("issue_key", classify.status_tone(F.col("status")).alias("tone"))
