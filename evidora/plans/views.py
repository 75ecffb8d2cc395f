"""Deterministic views that give the shared test tables the shape of issues, comments, pages and questions.

The same SQL text runs in Spark and in DuckDB, so that a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFECTS = """
SELECT doc_id, 'EVD-' || CAST(1000 + doc_id AS STRING) AS issue_key,
 substr(text,1,80) AS summary,
 text || CASE doc_id % 6 WHEN 0 THEN ' The publish failed because of a mapping error.' WHEN 1 THEN ' Job timeout due to slow performance.'
   WHEN 2 THEN ' Fixed by remap of the payload and sync rerun.' WHEN 3 THEN ' Permission role missing, 403 Forbidden.'
   WHEN 4 THEN ' See EVD-' || CAST(1000 + (doc_id * 7) % 500 AS STRING) || ' duplicate of EVD-1010.' ELSE '' END AS description,
 CASE doc_id % 7 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Open' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'Done' WHEN 5 THEN 'Verified' ELSE 'Rejected' END AS status,
 CASE doc_id % 5 WHEN 0 THEN 'Fixed' WHEN 1 THEN '' WHEN 2 THEN 'Duplicate' WHEN 3 THEN 'Done' ELSE 'Wont Fix' END AS resolution,
 CASE doc_id % 4 WHEN 0 THEN '1 - Critical' WHEN 1 THEN '2 - High' WHEN 2 THEN '3 - Normal' ELSE '4 - Low' END AS priority,
 split(CASE doc_id % 3 WHEN 0 THEN 'sync;api' WHEN 1 THEN 'dashboard' ELSE 'job;pipeline' END, ';') AS components,
 split(CASE doc_id % 2 WHEN 0 THEN 'prod;customer' ELSE 'stage' END, ';') AS labels,
 CASE doc_id % 2 WHEN 0 THEN 'Production' ELSE 'Stage' END AS environment, lang AS product, source AS team
FROM documents"""

COMMENTS = """
SELECT 'EVD-' || CAST(1000 + conv_id AS STRING) AS issue_key, turn AS pos, role AS author, text AS body FROM conversations"""

def _pages(file: str) -> str:
    return f"""
SELECT {file} AS source_file, CAST(floor(doc_id / 20.0) AS BIGINT) + 1 AS pdf_page_number,
 CASE WHEN floor(doc_id / 20.0) % 5 = 4 THEN 'TABLE' ELSE 'TEXT' END AS element_type,
 CASE WHEN floor(doc_id / 20.0) % 12 = 0 THEN 'Part ' || CAST(CAST(floor(doc_id / 240.0) AS BIGINT) AS STRING) END AS h1_here,
 CASE WHEN floor(doc_id / 20.0) % 3 = 0 THEN 'Topic ' || CAST(CAST(floor(doc_id / 60.0) AS BIGINT) AS STRING) END AS h2_here,
 CASE WHEN floor(doc_id / 20.0) % 5 = 4 THEN '| Flag | Level | Product |' || chr(10) || '|---|---|---|' || chr(10) || '| f' || CAST(doc_id AS STRING) || ' | org | ' || lang || ' |' ELSE text END AS content
FROM documents"""


#: Pages of documents: a file a source and 500 pages, so that there are more files, not longer ones, as the table grows.
ELEMENTS = _pages("source || '-' || CAST(CAST(floor(doc_id / 10000.0) AS BIGINT) AS STRING)")

#: The same pages, all of a source in one file, which gets longer as the table grows.
WHOLE_FILES = _pages("source")

SLA = """
SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 14 WHEN '5-LOW' THEN 30 ELSE 14 END AS target_days,
 CASE WHEN o_totalprice >= 400000 THEN 'CFP1' WHEN o_totalprice >= 150000 THEN 'CFP2' WHEN o_totalprice >= 80000 THEN 'CFP3' ELSE 'CFP4' END AS band,
 o_orderstatus = 'O' AS is_open, CAST(o_orderdate AS DATE) AS created FROM orders"""

#: The five-column chunk table of the retrieval queries: one text each, plain enough to tokenize alike in both engines.
CHUNKS = f"""
SELECT issue_key || '::problem_chunk' AS chunk_id, issue_key, 'problem_chunk' AS chunk_type, summary || ' ' || description AS text, * EXCLUDE (issue_key) FROM ({DEFECTS}) p
UNION ALL
SELECT issue_key || '::fix_chunk' AS chunk_id, issue_key, 'fix_chunk' AS chunk_type, description || ' ' || environment AS text, * EXCLUDE (issue_key) FROM ({DEFECTS}) f"""

QUESTIONS = """
SELECT item_id + 5000 AS qid, text AS question FROM benchmark
UNION ALL SELECT * FROM (VALUES
 (1001, 'why did the publish fail with a mapping error'), (1002, 'similar defects for job timeout'), (1003, 'EVD-1010 root cause'), (1004, 'hello'),
 (1005, 'show the full table'), (1006, 'how to upload data'), (1007, 'feature flag list'), (1008, 'opening hours'), (1009, 'asset sync'),
 (1010, 'user feature flag is enabled, energy default baseline no'), (1011, 'permission role missing 403 forbidden'), (1012, 'what are the onboarding steps'),
 (1013, 'coexist flag disabled and eo default baseline: yes'), (1014, 'can you please tell me about the flags'), (1015, 'Onboarding Steps Include:'),
 (1016, 'remap of the payload and sync rerun'), (1017, ''), (1018, 'list all the rows'), (1019, 'xy'), (1020, 'don''t show the widget')) AS t(qid, question)"""

#: Table fragments, one an order and a file a customer: they follow each other on adjacent pages, on one page, over gaps, and with other headers.
FRAGMENTS = """
SELECT source_file, CAST(CASE WHEN frag % 5 = 3 THEN frag - 1 ELSE frag END + 2 * floor(frag / 6.0) AS INTEGER) AS page, CAST(frag AS INTEGER) AS frag,
 CASE CAST(floor(frag / 3.0) AS INTEGER) % 4 WHEN 0 THEN 'flag;level;product' WHEN 1 THEN 'name;value' WHEN 2 THEN 'name;value;unit' ELSE 'energy widget;coexist;eo default' END AS headers,
 CASE k % 7 WHEN 0 THEN 'table continues' WHEN 1 THEN 'see next' WHEN 2 THEN 'cont.' ELSE '' END AS cue,
 CASE CAST(floor(frag / 3.0) AS INTEGER) % 4 WHEN 0 THEN 'Feature Flag Options' WHEN 1 THEN 'Limits' WHEN 2 THEN 'Limits' ELSE CASE WHEN k % 2 = 0 THEN 'Widget dashboard' ELSE '' END END AS section
FROM (SELECT 'c' || CAST(o_custkey AS STRING) || '.pdf' AS source_file, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS frag FROM orders) o"""


def spark_sql(text: str) -> str:
    """The few words that differ: EXCLUDE is EXCEPT, and split takes a pattern (a semicolon is one either way)."""
    return text.replace("* EXCLUDE", "* EXCEPT")


#: Bytes a core below which a table is dealt out before it is read.
SMALL = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One with fewer files than there are cores, and little for each core, is dealt over the cores, as a file of
    one row group keeps but one of them busy; all others are read as they lie, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and len(df.inputFiles()) < cores else df


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        (table(spark, sf_dir, t) if t == "documents" else spark.read.parquet(f"{sf_dir}/{t}.parquet")).createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    register(spark, sf_dir, *[t for t in ("documents", "conversations", "orders", "benchmark") if f"FROM {t}" in text])
    return spark.sql(spark_sql(text))
