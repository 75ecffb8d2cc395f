"""File sources and sinks: tolerant JSON, JSON lines, flat CSV, and nested raw issues."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = True) -> DataFrame:
    """Rows of a JSON file or folder; a missing path has none, and corrupt records are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=multi_line, mode="DROPMALFORMED")


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return read_json(spark, path, schema, multi_line=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Every part file one JSON array of its rows, written row by row, so that any of them is a whole document."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                said = [*([before + ","] if before is not None else []), *[r + "," for r in rows[:-1]]]
                before = rows[-1]
                if said:
                    yield pa.RecordBatch.from_arrays([pa.array(said)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([*([before] if before is not None else []), "]"])], ["value"])

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).mapInArrow(lines, "value string").write.mode("overwrite").option("compression", "none").text(path)


def flat(df: DataFrame, sep: str = "; ") -> DataFrame:
    """Arrays of strings as joined text, so that rows fit a CSV file."""
    return df.select(*[F.array_join(f"`{c}`", sep).alias(c) if t == "array<string>" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat(df.select(*columns)).write.mode("overwrite").csv(path, header=True, escape='"')


def field(raw: Column, *names: str) -> Column:
    """First non-null of the names, each looked up at the top and then under ``fields``; ``raw`` is a JSON text."""
    return F.coalesce(*[x for n in names for x in (F.get_json_object(raw, f"$.{n}"), F.get_json_object(raw, f"$.fields.{n}"))])


def value_name(value: Column) -> Column:
    """Human name of a JSON value: a struct's name, value, displayName or display_name; an array's names joined; else the text."""
    v = T.strip(T.blank(value))
    named = T.first_nonempty(*[T.strip(T.blank(F.get_json_object(v, f"$.{k}"))) for k in ("name", "value", "displayName", "display_name")])
    return F.when(v.startswith("{"), named).when(v.startswith("["), F.array_join(value_list(value), ", ")).otherwise(v)


def value_list(value: Column) -> Column:
    """JSON value as a list of names that aren't empty."""
    v = T.strip(T.blank(value))
    items = F.from_json(v, "array<string>")
    one = lambda x: F.when(x.startswith("{"), T.first_nonempty(*[T.strip(T.blank(F.get_json_object(x, f"$.{k}"))) for k in ("name", "value", "displayName", "display_name")])).otherwise(T.strip(T.blank(x)))
    many = F.filter(F.transform(items, one), lambda x: x != "")
    single = F.filter(F.array(one(v)), lambda x: x != "")
    return F.when(v.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(single)


#: Logical custom fields and the ids they have unless a file names others.
CUSTOM_FIELDS = {"environment": "customfield_10167", "product_module": "customfield_11907", "team": "customfield_12801", "scrum_team": "customfield_10001", "root_cause": "customfield_10580", "reported_by": "customfield_12051"}


def custom_fields(given: dict | None = None) -> dict[str, str]:
    return CUSTOM_FIELDS | {k: v["id"] for k, v in (given or {}).items() if isinstance(v, dict) and v.get("id")}


def raw_issues(rows: DataFrame, raw: str = "raw", fields: dict[str, str] | None = None) -> DataFrame:
    """Flat issues from JSON texts, ready for ``records.normalize``."""
    r, cf = F.col(raw), custom_fields() | (fields or {})
    name = lambda *n: value_name(field(r, *n))
    return rows.select(
        name("key").alias("issue_key"), name("summary").alias("summary"), rich_text(field(r, "description")).alias("description"), name("status").alias("status"), name("resolution").alias("resolution"),
        name("priority").alias("priority"), F.coalesce(F.nullif(name("issuetype", "issue_type"), F.lit("")), F.lit("Defect")).alias("issue_type"), value_list(field(r, "components")).alias("components"),
        value_list(field(r, "labels")).alias("labels"), name(cf["environment"], "environment").alias("environment"), name(cf["product_module"]).alias("product"), name(cf["team"], cf["scrum_team"]).alias("team"),
        name("reporter").alias("reporter"), F.coalesce(F.nullif(name("assignee"), F.lit("")), F.lit("Unassigned")).alias("assignee"), F.left(name("created"), F.lit(10)).alias("created"), F.left(name("updated"), F.lit(10)).alias("updated"),
        F.left(name("resolutiondate", "resolution_date", "resolved"), F.lit(10)).alias("resolved"), name(cf["root_cause"]).alias("root_cause_raw"), name("resolution_description", "fix_description").alias("resolution_description_raw"),
        name("steps_to_reproduce").alias("steps_to_reproduce"), field(r, "comment.comments").alias("comments_json"),
    )


def flatten_rich_text(node) -> str:
    """Text of a rich-text tree; paragraphs, headings, items and cells end a line."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(map(flatten_rich_text, node))
    if not isinstance(node, dict):
        return ""
    own = node.get("text", "") if node.get("type") == "text" else ""
    end = "\n" if node.get("type") in ("paragraph", "heading", "listItem", "tableRow", "tableCell") else ""
    return own + flatten_rich_text(node.get("content") or []) + end


def rich_text(value: Column) -> Column:
    """Plain text of a field that may be a rich-text tree: recursion has no column form, so trees alone go through Arrow."""

    @F.pandas_udf("string")
    def flat_text(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return flatten_rich_text(json.loads(v))
            except (TypeError, ValueError):
                return v or ""

        return values.map(one)

    return F.when(T.blank(value).startswith("{"), flat_text(value)).otherwise(T.blank(value))


def embedded_comments(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(issue_key, pos, author, created, body) of the comments inside searched issues; bodies may be rich-text trees."""
    one = "array<struct<author:string,created:string,body:string>>"
    found = F.from_json(F.coalesce(F.get_json_object(raw, "$.fields.comment.comments"), F.lit("[]")), one)
    flat = rows.select(F.get_json_object(raw, "$.key").alias("issue_key"), F.posexplode(found).alias("pos", "c"))
    author = F.when(F.col("c.author").startswith("{"), T.first_nonempty(F.get_json_object("c.author", "$.displayName"), F.get_json_object("c.author", "$.name"))).otherwise(T.blank(F.col("c.author")))
    return flat.select("issue_key", "pos", author.alias("author"), F.left(T.blank(F.col("c.created")), F.lit(10)).alias("created"), rich_text(F.col("c.body")).alias("body"))


def event_frames(rows: list[dict], event: str = "token") -> list[str]:
    """Server-sent frames of result rows."""
    return [f"data: {json.dumps({'type': event, **r}, ensure_ascii=False, default=str)}\n\n" for r in rows]


def parse_frames(text: str) -> list[dict]:
    return [json.loads(line[6:]) for block in text.split("\n\n") for line in block.splitlines() if line.startswith("data: ")]
