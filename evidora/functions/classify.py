"""Classification and routing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import blank, issue_keys, let, strip


def has_any(c: Column, cues: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda cue: F.contains(c, cue))


def hits(c: Column, cues: list[str]) -> Column:
    """How many of the cues occur."""
    return F.size(F.filter(F.array(*map(F.lit, cues)), lambda cue: F.contains(c, cue)))


def is_fixed(status: Column, resolution: Column) -> Column:
    return F.lower(strip(blank(status))).isin(vocab.FIXED_STATUSES) | F.lower(strip(blank(resolution))).isin(vocab.FIXED_RESOLUTIONS)


def is_cancelled(status: Column, resolution: Column) -> Column:
    return F.lower(strip(blank(status))).isin(vocab.CANCELLED_STATUSES) | F.lower(strip(blank(resolution))).isin(vocab.CANCELLED_RESOLUTIONS)


def category(c: Column, cues: dict[str, list[str]]) -> Column:
    """The category whose cues occur most often, the first of equals; '' if none occurs."""
    known = F.array(*[F.struct(F.array(*map(F.lit, words)).alias("words"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(cues.items())])

    def count(low: Column, words: Column) -> Column:
        times = lambda w: ((F.char_length(low) - F.char_length(F.replace(low, w, F.lit("")))) / F.char_length(w)).cast("int")
        return F.aggregate(words, F.lit(0), lambda n, w: F.when(F.contains(low, w), n + times(w)).otherwise(n))

    best = let(F.lower(blank(c)), lambda low: F.array_max(F.transform(known, lambda k: F.struct(count(low, k["words"]).alias("n"), k["place"].alias("place"), k["name"].alias("name")))))
    return let(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise(F.lit("")))


def fix_pattern(c: Column, hint: Column | None = None) -> Column:
    h = F.lower(blank(hint if hint is not None else F.lit("")))
    fallback = F.when(has_any(h, ["sync", "model", "integration"]), "Data Sync-Integration").when(has_any(h, ["config", "environment"]), "Config-Environment").when(has_any(h, ["ui", "frontend"]), "UI-Frontend").when(has_any(h, ["data"]), "Data Cleanup").otherwise("Unknown")
    return let(category(c, vocab.FIX_PATTERN_CUES), lambda found: F.when(found != "", found).otherwise(fallback))


def defect_type(c: Column) -> Column:
    return let(category(c, vocab.DEFECT_TYPE_CUES), lambda found: F.when(found != "", found).otherwise(F.lit("unknown")))


def quality(summary: Column, problem: Column, has_comments: Column, root_cause: Column, fix: Column, has_components: Column, error: Column, fixed: Column, cancelled: Column) -> Column:
    """Completeness from 0 to 1."""
    add = lambda yes, w: F.when(yes, F.lit(w)).otherwise(F.lit(0.0))
    total = add(blank(summary) != "", 0.15) + add(F.char_length(blank(problem)) > 40, 0.15) + add(has_comments, 0.15) + add(blank(root_cause) != "", 0.18) + add(blank(fix) != "", 0.18) + add(has_components, 0.05) + add(blank(error) != "", 0.06) + add(fixed, 0.08)
    total = total - add(cancelled & (blank(root_cause) == "") & (blank(fix) == ""), 0.20)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 3)))


def intent(question: Column, mode: Column | None = None) -> Column:
    """What a question asks for; ``mode`` 'defect' rules out help."""
    q = F.lower(strip(blank(question)))
    technical = blank(question).rlike(vocab.TECHNICAL)
    n_words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    found = (
        F.when(q == "", "GENERAL_HELP").when(F.size(issue_keys(question)) > 0, "DEFECT_BY_KEY").when(has_any(q, vocab.SIMILAR_CUES), "SIMILAR_DEFECTS").when(has_any(q, vocab.DIAGNOSTIC_CUES), "DEFECT_DIAGNOSTIC")
        .when(has_any(q, vocab.HELP_CUES) & ~technical, "GENERAL_HELP").when((n_words <= 2) & ~technical, "GENERAL_HELP").otherwise("DEFECT_DIAGNOSTIC")
    )
    if mode is not None:
        found = F.when((mode == "defect") & (found == "GENERAL_HELP"), "DEFECT_DIAGNOSTIC").otherwise(found)
    return found


def conditions(question: Column) -> Column:
    """Map of the conditions a question states; of two values of one field the later pattern's counts."""
    q, out = blank(question), []
    for field in dict.fromkeys(f for _, f, _ in vocab.CONDITIONS):
        value = F.lit(None).cast("string")
        for pattern, f, v in vocab.CONDITIONS:
            if f == field:
                value = F.when(q.rlike(pattern), F.lit(v)).otherwise(value)
        out += [F.lit(field), value]
    return F.map_filter(F.create_map(*out), lambda k, v: v.isNotNull())


def doc_route(question: Column) -> Column:
    q = blank(question)
    return (
        F.when((F.size(conditions(question)) > 0) | q.rlike(vocab.MATRIX_TERMS), "widget_matrix").when(q.rlike(vocab.FLAG_TERMS), "feature_flag_table")
        .when(q.rlike(vocab.TABLE_TERMS), "table_full").when(q.rlike(vocab.TEXT_TERMS), "text_section").otherwise("hybrid")
    )


def missing_conditions(question: Column) -> Column:
    """Sorted required conditions that a matrix question leaves open."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, vocab.REQUIRED_CONDITIONS)), F.map_keys(conditions(question))))
    return F.when(doc_route(question) == "widget_matrix", missing).otherwise(F.array().cast("array<string>"))


def table_type(headers: Column, section: Column) -> Column:
    h, s = F.lower(F.array_join(headers, " ")), F.lower(blank(section))
    return (
        F.when(has_any(s, vocab.MATRIX_SECTION_WORDS) | (hits(h, vocab.MATRIX_HEADER_WORDS) >= 2), "conditional_matrix")
        .when(has_any(s, vocab.FLAG_SECTION_WORDS) | (hits(h, vocab.FLAG_HEADER_WORDS) >= 2), "feature_flags").otherwise("generic_table")
    )


def flag_value(c: Column) -> Column:
    """Flag states with broken spelling repaired."""
    v = strip(blank(c))
    return F.when(v.rlike(r"(?i)^ena\w*\s*\w*$"), "Enabled").when(v.rlike(r"(?i)^dis\w*\s*\w*$"), "Disabled").otherwise(v)


def baseline_value(c: Column) -> Column:
    v = strip(blank(c))
    return F.when(v.rlike(r"(?i)^ena\w*\s*\w*$"), "Yes").when(v.rlike(r"(?i)^dis\w*\s*\w*$"), "No").when(F.lower(v).isin("yes", "no"), F.initcap(F.lower(v))).otherwise(v)


def status_tone(status: Column) -> Column:
    s = F.lower(blank(status))
    return F.when(s.rlike("fixed|done|closed|resolved|verified|completed"), "good").when(s.rlike("cancel|reject|duplicate|won"), "muted").when(s.rlike("progress|review|test"), "active").otherwise("open")


def sla_days(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", 3).when(priority == "2-HIGH", 7).when(priority == "3-MEDIUM", 14).when(priority == "5-LOW", 30).otherwise(14)


def price_band(value: Column) -> Column:
    return F.when(value >= 400000, "CFP1").when(value >= 150000, "CFP2").when(value >= 80000, "CFP3").otherwise("CFP4")
