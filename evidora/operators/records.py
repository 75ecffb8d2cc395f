"""From raw issues to evidence records and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, vocab
from ..functions import text as T

NO_TEXT = F.lit


def name_of(c: Column) -> Column:
    """Name of a value that is a struct with name, value, displayName or display_name, given as a map of strings."""
    return T.first_nonempty(*[T.strip(T.blank(F.try_element_at(c, F.lit(k)))) for k in ("name", "value", "displayName", "display_name")])


def names_of(c: Column) -> Column:
    """The stripped strings of an array that aren't empty."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: T.strip(T.blank(x))), lambda x: x != "")


def with_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues with their cleaned, non-empty comments (author, body) in order of ``pos``: a left join on the key."""
    cleaned = comments.select("issue_key", "pos", F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")).alias("author"), T.clean(F.col("body")).alias("body")).where("body <> ''")
    grouped = cleaned.groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("pos", "author", "body"))).alias("comments"))
    return issues.join(grouped, "issue_key", "left").withColumn("comments", F.coalesce("comments", F.array().cast(grouped.schema["comments"].dataType)))


def first_hints(hints: DataFrame) -> DataFrame:
    """(issue_key, hint) of (pos, pattern, keys): the first pattern that names a key counts."""
    named = hints.select("pos", "pattern", F.explode("keys").alias("issue_key"))
    return named.groupBy("issue_key").agg(F.min_by("pattern", "pos").alias("hint"))


def with_insights(issues: DataFrame, insights: DataFrame) -> DataFrame:
    """Issues with the insights (issue_key, root_cause, fix_applied, key_finding, workaround) there are: a left join on the key."""
    named = {"root_cause": "ci_root", "fix_applied": "ci_fix", "key_finding": "ci_finding", "workaround": "ci_workaround"}
    one = insights.groupBy("issue_key").agg(*[F.first(c, True).alias(n) for c, n in named.items()])
    return issues.join(one, "issue_key", "left")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """(issue_key, chunk_ids): the chunks of each issue, in order."""
    return chunks.groupBy("issue_key").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def linked_keys(links: Column) -> Column:
    """Distinct keys of link structs with the four possible sides, in order."""
    sides = F.flatten(F.transform(links, lambda x: F.array(x["inwardIssue"]["key"], x["outwardIssue"]["key"])))
    return F.array_distinct(F.filter(sides, lambda k: T.blank(k) != ""))


_TEXTS = ("steps_to_reproduce", "root_cause_raw", "resolution_description_raw", "ci_root", "ci_fix", "ci_finding", "ci_workaround", "hint", "environment", "product", "team", "status", "resolution", "priority")


def normalize(issues: DataFrame, masked: bool = True, drop_cancelled: bool = False) -> DataFrame:
    """The enriched record of every issue with a key.

    Expects issue_key, summary, description and whatever else there is of the raw columns: comments (of
    ``with_comments``), components, labels and the texts in ``_TEXTS``; what is missing counts as empty.
    """
    have = set(issues.columns)
    df = issues.where(F.coalesce(F.col("issue_key"), F.lit("")) != "")
    for c in _TEXTS:
        df = df.withColumn(c, T.blank(F.col(c)) if c in have else F.lit(""))
    for c in ("components", "labels"):
        df = df.withColumn(c, names_of(F.col(c)) if c in have else F.array().cast("array<string>"))
    bodies = F.transform("comments", lambda x: x["body"]) if "comments" in have else F.array().cast("array<string>")
    clean = lambda c: T.clean(F.col(c), masked)
    for c in ("summary", "description", "steps_to_reproduce", "root_cause_raw", "resolution_description_raw", "ci_root", "ci_fix", "ci_finding", "ci_workaround"):
        df = df.withColumn(c, clean(c))
    col, lit = F.col, F.lit
    df = df.withColumn("project", T.project_of(col("issue_key"))).withColumn("comments_blob", F.array_join(bodies, "\n"))
    df = df.withColumn("is_fixed", classify.is_fixed(col("status"), col("resolution"))).withColumn("is_cancelled", classify.is_cancelled(col("status"), col("resolution")))
    labelled = lambda name, value: F.when(value != "", F.concat(lit(f"{name}: "), value)).otherwise(lit(""))
    df = df.withColumn("problem_text", T.truncate(T.join_nonempty([
        col("summary"), col("description"), col("steps_to_reproduce"), labelled("Components", F.array_join("components", ", ")),
        labelled("Environment", col("environment")), labelled("Labels", F.array_join("labels", ", ")), col("ci_finding")], ". "), 1200))
    df = df.withColumn("symptom_text", T.truncate(T.join_nonempty([col("summary"), col("ci_finding")], ". "), 320))
    df = df.withColumn("error_signature", T.error_signature(T.join_nonempty([col("summary"), col("description"), col("comments_blob")], " ")))
    said = lambda cues: T.first_sentence_with(col("comments_blob"), cues)
    df = df.withColumn("root_cause_extracted", T.truncate(T.first_nonempty(col("root_cause_raw"), col("ci_root"), col("resolution_description_raw"), said(vocab.ROOT_CAUSE_CUES)), 400))
    df = df.withColumn("fix_applied_extracted", T.truncate(T.first_nonempty(col("ci_fix"), col("resolution_description_raw"), said(vocab.FIX_CUES)), 400))
    df = df.withColumn("workaround_extracted", T.truncate(T.first_nonempty(col("ci_workaround"), said(vocab.WORKAROUND_CUES)), 300))
    df = df.withColumn("key_findings", T.truncate(col("ci_finding"), 400))
    df = df.withColumn("failure_area", T.join_nonempty([F.array_join("components", ", "), col("product"), col("team"), col("environment")], " | "))
    blob = T.join_nonempty([col(c) for c in ("summary", "problem_text", "error_signature", "root_cause_extracted", "fix_applied_extracted", "comments_blob")], " ")
    df = df.withColumn("classify_blob", blob)
    df = df.withColumn("fix_pattern", classify.fix_pattern(col("classify_blob"), col("hint"))).withColumn("defect_type", classify.defect_type(col("classify_blob"))).drop("classify_blob")
    df = df.withColumn("solution_text", T.truncate(T.join_nonempty([col(c) for c in ("root_cause_extracted", "fix_applied_extracted", "workaround_extracted", "resolution_description_raw")], ". "), 900))
    df = df.withColumn("search_text", T.truncate(T.join_nonempty([*[col(c) for c in ("summary", "problem_text", "symptom_text", "error_signature", "root_cause_extracted", "fix_applied_extracted", "workaround_extracted", "key_findings")], F.array_join("components", ", "), F.array_join("labels", ", "), col("environment"), col("product"), col("team")], ". "), 2000))
    df = df.withColumn("quality_score", classify.quality(col("summary"), col("problem_text"), F.size(bodies) > 0, col("root_cause_extracted"), col("fix_applied_extracted"), F.size("components") > 0, col("error_signature"), col("is_fixed"), col("is_cancelled")))
    return df.where(~col("is_cancelled")) if drop_cancelled else df


def statistics(records: DataFrame) -> DataFrame:
    """One row: records, fixed ones, those with a root cause, those with a fix."""
    return records.agg(F.count("*").alias("n"), F.count_if("is_fixed").alias("n_fixed"), F.count_if(F.col("root_cause_extracted") != "").alias("n_root_cause"), F.count_if(F.col("fix_applied_extracted") != "").alias("n_fix"))


_META = ("status", "resolution", "priority", "summary", "components", "labels", "environment", "product", "team", "fix_pattern", "defect_type", "failure_area", "root_cause_extracted", "fix_applied_extracted", "workaround_extracted", "quality_score", "is_fixed", "is_cancelled")


def chunks(records: DataFrame) -> DataFrame:
    """Up to five typed chunks of each record, with its metadata; texts under eight characters are left out."""
    c = F.col
    joined = lambda *parts: F.array_join(F.array(*parts), " ")
    comment = T.truncate(F.array_join(F.filter(F.split("comments_blob", "\n"), lambda x: x != ""), " \n"), 800)
    texts = {
        "problem_chunk": T.collapse(joined(c("summary"), c("problem_text"), c("symptom_text"), c("error_signature"))),
        "root_cause_chunk": joined(c("root_cause_extracted"), c("root_cause_raw"), F.lit(""), c("key_findings")),
        "fix_chunk": joined(c("fix_applied_extracted"), c("workaround_extracted"), c("resolution_description_raw"), c("solution_text")),
        "comment_insight_chunk": joined(c("key_findings"), comment),
        "full_context_chunk": joined(F.concat(F.lit("["), c("issue_key"), F.lit("]")), c("summary"), c("problem_text"), F.concat(F.lit("Root cause: "), c("root_cause_extracted")), F.concat(F.lit("Fix: "), c("fix_applied_extracted")), F.concat(F.lit("Status: "), c("status")), F.concat(F.lit("Priority: "), c("priority")), F.concat(F.lit("Components: "), F.array_join("components", ", ")), F.concat(F.lit("Fix pattern: "), c("fix_pattern"))),
    }
    rows = F.array(*[F.struct(F.lit(kind).alias("chunk_type"), T.strip(t).alias("raw")) for kind, t in texts.items()])
    out = records.select("issue_key", *[m for m in _META if m in records.columns], F.inline(rows)).where(F.char_length("raw") >= 8)
    return out.withColumn("text", T.truncate(c("raw"), 1500)).drop("raw").withColumn("chunk_id", F.concat_ws("::", "issue_key", "chunk_type"))
