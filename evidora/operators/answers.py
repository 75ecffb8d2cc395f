"""Deterministic, source-cited answers from retrieval results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answer_texts
from ..functions import text as T
from ..functions.page_parts import sections_of
from . import retrieval

HEAD = "| Key | Summary | Status | Priority | Root Cause | Fix Applied | Relevance |\n|---|---|---|---|---|---|---|"
FALLBACKS = {
    "no_chunks_found": "I searched the available documents but could not find any relevant information to answer your question.",
    "low_confidence_retrieval": "I found some potentially related content in the documents, but I am not confident it fully answers your question.",
    "out_of_scope": "This question appears to be outside the scope of the documents I have access to.",
    "unclear_intent": "Your question is a bit ambiguous. Could you provide more detail?",
}


def fallback(reason: str, extra: str = "") -> str:
    base = FALLBACKS.get(reason, FALLBACKS["no_chunks_found"])
    return f"{base}\n\n{extra}".strip() if extra else base


def _of(values: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key), F.lit(values["Unknown"]))


def similar_rows(results: DataFrame, base_url: str = "") -> DataFrame:
    """(qid, row, line): the table's lines for the primary results of each query."""
    key = F.concat(F.lit("["), "issue_key", F.lit(f"]({base_url}"), "issue_key", F.lit(")")) if base_url else F.col("issue_key")
    cells = [key, T.table_cell(F.col("summary")), F.col("status"), F.col("priority"), T.table_cell(F.col("root_cause_extracted")), T.table_cell(F.col("fix_applied_extracted")), F.round("relevance_score", 3).cast("string")]
    return retrieval.similar_table(results).select("qid", "row", F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"))


def answers(results: DataFrame, base_url: str = "") -> DataFrame:
    """(qid, answer): causes, earlier fixes, steps by the dominant pattern, the table, and warnings; Markdown."""
    primary = retrieval.similar_table(results)
    pattern = retrieval.dominant(primary, "fix_pattern").select("qid", F.col("fix_pattern").alias("pattern"))
    listed = lambda yes, x: F.slice(F.transform(F.array_sort(F.filter(F.collect_list(F.when(yes, F.struct("rank", x.alias("line")))), lambda r: r.isNotNull())), lambda r: r["line"]), 1, 5)
    bullet = lambda c: F.concat(F.lit("- "), "issue_key", F.lit(": "), F.col(c))
    inferred = F.concat(F.lit("- Inferred from similar defect "), "issue_key", F.lit(": "), "summary")
    gathered = primary.groupBy("qid").agg(listed(F.col("root_cause_extracted") != "", bullet("root_cause_extracted")).alias("causes"), listed(F.col("fix_applied_extracted") != "", bullet("fix_applied_extracted")).alias("fixes"), F.slice(listed(F.col("summary") != "", inferred), 1, 3).alias("inferred"))
    table = similar_rows(results, base_url).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("table"))
    dead = results.where("is_cancelled").groupBy("qid").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "issue_key"))), lambda r: r["issue_key"]), 1, 5), ", ").alias("dead"))
    df = gathered.join(pattern, "qid", "left").join(table, "qid", "left").join(dead, "qid", "left").withColumn("pattern", F.coalesce("pattern", F.lit("Unknown")))
    steps = F.array(*[F.lit(None).cast("string")])
    steps = _of({k: "\n".join(f"{i}. {s}" for i, s in enumerate([*v, "Validate against the cited fixed defects below before closing."], 1)) for k, v in answer_texts.STEPS.items()}, F.col("pattern"))
    likely = F.concat(F.lit("- **Most likely cause ("), "pattern", F.lit("):** "), _of(answer_texts.LIKELY_CAUSES, F.col("pattern")))
    causes = F.when(F.size("causes") > 0, F.array_join("causes", "\n")).otherwise(F.concat_ws("\n", F.array(likely), "inferred"))
    fixes = F.when(F.size("fixes") > 0, F.array_join("fixes", "\n")).otherwise(F.lit("- No fix text was recorded on the closest defects; apply the inferred fix steps below, validated against the cited defects."))
    text = F.concat_ws("\n", F.lit("## Root Causes"), causes, F.lit("\n## How Similar Defects Were Fixed Earlier"), fixes, F.lit("\n## Suggested Fix Steps"), steps, F.lit("\n## Similar Fixed Defects"), F.concat(F.lit(HEAD + "\n"), F.coalesce("table", F.lit(""))), F.concat(F.lit("\n> ⚠️ Dead-ends (cancelled/rejected): "), "dead"))
    return df.select("qid", "pattern", text.alias("answer"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """(qid, context): hits in reading order as blocks labelled S1, S2, ..."""
    label = F.concat(F.lit("[S"), F.row_number().over(Window.partitionBy("qid").orderBy("source_file", "sequence_id")).cast("string"), F.lit("] "), "source_file", F.lit(" p."), F.col("page").cast("string"))
    rows = hits.withColumn("__b", F.concat_ws("\n", label, "display"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_file", "sequence_id", "__b"))), lambda r: r["__b"]), "\n\n").alias("context"))


def missing_values(answer: Column, values: dict[str, Column]) -> Column:
    """Names of the values that the answer doesn't hold, whatever the case."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), T.blank(v).alias("v")) for n, v in values.items()])
    return F.transform(F.filter(pairs, lambda x: (x["v"] != "") & ~F.contains(F.lower(answer), F.lower(x["v"]))), lambda x: x["n"])


def keep_sections(markdown: str, wanted: list[str]) -> str:
    """The sections of one answer whose headings hold one of the wanted titles; for many answers there is ``table_functions.AnswerSections``."""
    return "\n\n".join(section for _, section in sections_of(markdown, wanted)).strip()


def history_tail(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, in order."""
    w = Window.partitionBy("conv_id")
    kept = turns.withColumn("__r", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("__r") <= n).drop("__r")
    return kept.withColumn("place", F.row_number().over(w.orderBy("turn")))


def previous_question(turns: DataFrame) -> DataFrame:
    """Adds the nearest earlier user turn's text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w))


def fused_answer(defects: Column, documents: Column) -> Column:
    """Both answers under a heading each; without one from the documents the other as it is."""
    both = F.concat(F.lit(f"{answer_texts.DEFECT_HEADER}\n\n"), defects, F.lit(f"\n\n---\n\n{answer_texts.DOC_HEADER}\n\n"), documents)
    return F.when(F.coalesce(documents, F.lit("")) == "", defects).otherwise(both)


def document_question(symptom: Column, bridge=None) -> Column:
    """A symptom as a question to the documents: by ``bridge`` (a function of columns) if there is one and it finds any, else the symptom itself."""
    own = F.trim(F.coalesce(symptom, F.lit("")))
    return own if bridge is None else F.coalesce(F.nullif(F.trim(bridge(own)), F.lit("")), own)
