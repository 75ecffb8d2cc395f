"""Conversations of a client: titles, dates, search and keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def derive_title(first: Column) -> Column:
    """At most 48 characters of the first question."""
    return T.let(T.strip(F.regexp_replace(T.blank(first), r"\s+", " ")), lambda c: F.when(c == "", "New chat").when(F.char_length(c) > 48, F.concat(F.regexp_replace(F.left(c, F.lit(48)), r"\s+$", ""), F.lit("…"))).otherwise(c))


def date_bucket(ts: Column, now: Column) -> Column:
    """Section of a list by date, as seen at ``now``."""
    days = F.date_diff(now.cast("date"), ts.cast("date"))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "Previous 7 days").when(days <= 30, "Previous 30 days").otherwise(F.date_format(ts, "MMMM yyyy"))


def relative_time(ts: Column, now: Column) -> Column:
    """How long ago, in words."""
    sec = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    minutes = F.round(sec / 60).cast("bigint")
    hours = F.round(minutes / 60).cast("bigint")
    days = F.round(hours / 24).cast("bigint")
    weeks = F.round(days / 7).cast("bigint")
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(sec < 45, "just now").when(minutes < 60, say(minutes, "m")).when(hours < 24, say(hours, "h")).when(days < 7, say(days, "d")).when(weeks < 5, say(weeks, "w")).otherwise(F.date_format(ts, "MMM d"))


def search_titles(conversations: DataFrame, query: str) -> DataFrame:
    """Titles that hold the query, whatever the case; an empty query keeps all."""
    q = query.strip().lower()
    return conversations.where(F.contains(F.lower("title"), F.lit(q))) if q else conversations


def change(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (conv_id, op, title): rename, pin, unpin, delete; one change for each conversation."""
    df = conversations.join(changes.select("conv_id", "op", F.col("title").alias("__title")), "conv_id", "left").where("op IS NULL OR op <> 'delete'")
    df = df.withColumn("title", F.when((F.col("op") == "rename") & (T.strip(T.blank(F.col("__title"))) != ""), T.strip(F.col("__title"))).otherwise(F.col("title")))
    return df.withColumn("pinned", F.when(F.col("op") == "pin", True).when(F.col("op") == "unpin", False).otherwise(F.col("pinned"))).drop("op", "__title")


def history_messages(turns: DataFrame) -> DataFrame:
    """(…, role, content): question and answer pairs as messages; empty ones are left out."""
    rows = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), T.strip(T.blank(F.col("question"))).alias("content")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), T.strip(T.blank(F.col("answer"))).alias("content")))
    return turns.select(*[c for c in turns.columns if c not in ("question", "answer")], F.inline(rows)).where("content <> ''")


def evidence_line(prefix: str = "") -> Column:
    """One result as lines of a prompt."""
    c = lambda n: F.col(prefix + n)
    known = lambda n: F.coalesce(F.nullif(c(n), F.lit("")), F.lit("n/a"))
    return F.concat(F.lit("- "), c("issue_key"), F.lit(" | status="), c("status"), F.lit(" | priority="), c("priority"), F.lit(" | fix_pattern="), c("fix_pattern"), F.lit(" | relevance="), c("relevance_score").cast("string"), F.lit("\n  summary: "), c("summary"), F.lit("\n  root_cause: "), known("root_cause_extracted"), F.lit("\n  fix_applied: "), known("fix_applied_extracted"))


def prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, prompt): the question and its evidence, best first, for a language model if one is plugged in."""
    rows = results.select("qid", "rank", evidence_line().alias("line")).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return questions.join(rows, "qid", "left").select("qid", F.concat_ws("\n", F.lit("QUESTION:"), "question", F.lit("\nSIMILAR DEFECTS:"), F.coalesce("lines", F.lit("(none)"))).alias("prompt"))


def distinct_variants(question: Column, rewritten: Column, variants: Column, most: int = 3) -> Column:
    """The first ``most`` variants, stripped, without empty ones, those equal (in any case) to the question or its rewriting, and repeats."""
    plain = F.transform(F.slice(variants, 1, most), lambda v: T.strip(T.blank(v)))
    low = lambda c: F.lower(T.strip(T.blank(c)))

    def kept(found: Column) -> Column:
        return T.let(F.transform(found, F.lower), lambda lows: F.filter(found, lambda v, i: (v != "") & ~F.lower(v).isin(low(question), low(rewritten)) & (F.array_position(lows, F.lower(v)) == i + 1)))

    return T.let(plain, kept)
