"""Markdown tables: parsing, types, continuation over pages, whole tables and row chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, ids
from ..functions import text as T

SEPARATOR = r"^\|?[\s:|-]*-[\s:|-]*\|?$"
CUE = r"(?i)\b(continued?|cont\.?|see\s+next|table\s+continues?)\b"
THRESHOLD = 0.45


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(T.strip(line), r"^\|+|\|+$", ""), r"\|"), T.strip)


def parse_table(df: DataFrame, markdown: str) -> DataFrame:
    """Adds raw_headers, headers and rows: the first line names the columns, rows are padded or cut to as many."""
    ln = F.filter(F.split(T.strip(F.col(markdown)), r"\n"), lambda x: T.strip(x) != "")
    df = df.withColumn("__l", ln).withColumn("raw_headers", F.when(F.size("__l") >= 2, _cells(F.element_at("__l", 1))).otherwise(F.array().cast("array<string>")))
    n = F.size("raw_headers")
    body = F.filter(F.slice("__l", F.lit(2), F.size("__l")), lambda x: ~T.strip(x).rlike(SEPARATOR))
    fit = lambda x: F.slice(F.concat(_cells(x), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    rows = F.when(n > 0, F.transform(body, fit)).otherwise(F.array().cast("array<array<string>>"))
    return df.withColumn("headers", F.transform("raw_headers", T.header_name)).withColumn("rows", rows).drop("__l")


def signature(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.lower(T.strip(h))), "|")


def header_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the header sets; 1 for two empty ones, 0 for one."""
    na, nb = F.array_distinct(F.transform(a, T.header_name)), F.array_distinct(F.transform(b, T.header_name))
    union = F.size(F.array_union(na, nb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(na, nb)) / union)


def continuation(prev: Column, cur: Column) -> tuple[Column, Column]:
    """(confidence, reasons) that a fragment (source_file, page, headers, cue, table_type) goes on from the one before.

    Six weighted signs; one that can't be judged leaves the weights out as well.
    """
    gap = cur["page"] - prev["page"]
    known = (F.size(prev["headers"]) > 0) & (F.size(cur["headers"]) > 0)
    like = F.when(signature(prev["headers"]) == signature(cur["headers"]), F.lit(1.0)).otherwise(header_likeness(prev["headers"], cur["headers"]))
    same_n = F.size(prev["headers"]) == F.size(cur["headers"])
    cue, kind, file = F.coalesce(prev["cue"], F.lit("")).rlike(CUE), prev["table_type"] == cur["table_type"], prev["source_file"] == cur["source_file"]
    signs = [
        (F.lit(True), 0.20, F.when(gap == 1, 1.0).when(gap == 0, 0.0).otherwise(-1.5), F.when(gap == 1, "adjacent_pages")),
        (known, 0.35, like, F.when(known & (signature(prev["headers"]) == signature(cur["headers"])), "identical_headers").when(known & (like >= 0.5), "similar_headers")),
        (known, 0.15, same_n.cast("double"), F.when(known & same_n, "same_column_count")),
        (file, 0.10, F.lit(1.0), F.when(file, "same_source_file")),
        (cue, 0.15, F.lit(1.0), F.when(cue, "continuation_cue_in_text")),
        (kind, 0.05, F.lit(1.0), F.when(kind, "same_table_type")),
    ]
    weight = sum((F.when(yes, w).otherwise(0.0) for yes, w, _, _ in signs), F.lit(0.0))
    score = sum((F.when(yes, w * v).otherwise(0.0) for yes, w, v, _ in signs), F.lit(0.0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / weight))
    reasons = F.concat_ws("; ", *[r for *_, r in signs])
    return confidence, F.when(reasons == "", "no_positive_signals").otherwise(reasons)


def chains(fragments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds confidence, reasons and chain (from 1 within a file) to fragments in order of page and frag."""
    w = Window.partitionBy("source_file").orderBy("page", "frag")
    df = fragments.withColumn("__me", F.struct("source_file", "page", "headers", "cue", "table_type")).withColumn("__prev", F.lag("__me").over(w))
    confidence, reasons = continuation(F.col("__prev"), F.col("__me"))
    df = df.withColumn("confidence", F.when(F.col("__prev").isNotNull(), F.round(confidence, 4))).withColumn("reasons", F.when(F.col("__prev").isNotNull(), reasons))
    new = F.when(F.coalesce(F.col("confidence") >= threshold, F.lit(False)), 0).otherwise(1)
    return df.withColumn("chain", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__me", "__prev")


def whole_tables(chained: DataFrame) -> DataFrame:
    """One row for each chain: pages, fragments, rows, mean confidence, reasons, and one group id for all its fragments."""
    row = F.struct("page", "frag", "confidence", "reasons", "rows")
    grouped = chained.groupBy("source_file", "chain").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_fragments"), F.min_by("headers", F.struct("page", "frag")).alias("headers"), F.min_by("table_type", F.struct("page", "frag")).alias("table_type"), F.array_sort(F.collect_list(row)).alias("parts"))
    rest = F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1))
    conf = F.when(F.size("parts") > 1, F.aggregate(rest, F.lit(0.0), lambda s, x: s + x["confidence"]) / (F.size("parts") - 1)).otherwise(F.lit(1.0))
    why = F.when(F.size("parts") > 1, F.array_join(F.transform(rest, lambda x: x["reasons"]), " | ")).otherwise(F.lit("single_fragment"))
    out = grouped.withColumn("avg_confidence", F.round(conf, 4)).withColumn("reason", why).withColumn("rows", F.flatten(F.transform("parts", lambda x: x["rows"])))
    return out.withColumn("group_id", ids.stable_id(F.col("source_file"), F.col("chain"), prefix="tbl_")).withColumn("n_rows", F.size("rows")).drop("parts")


def numbered_rows(chained: DataFrame) -> DataFrame:
    """Every row with row_index in its whole table, fragment_index and fragment_row_index, padded to the first headers."""
    w = Window.partitionBy("source_file", "chain").orderBy("page", "frag")
    df = chained.withColumn("fragment_index", F.row_number().over(w) - 1).withColumn("__n", F.size(F.first("headers").over(w)))
    df = df.select("source_file", "chain", "page", "fragment_index", "__n", F.posexplode("rows").alias("fragment_row_index", "cells"))
    df = df.withColumn("cells", F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("__n"))), F.lit(1), F.col("__n"))).drop("__n")
    return df.withColumn("row_index", F.row_number().over(Window.partitionBy("source_file", "chain").orderBy("fragment_index", "fragment_row_index")) - 1)


def markdown_of(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(rows, line), "\n"))


def json_of(headers: Column, rows: Column) -> Column:
    return F.to_json(F.struct(headers.alias("headers"), rows.alias("rows")))


def row_sentence(headers: Column, cells: Column) -> Column:
    """'header: cell' for the cells that aren't empty, joined by pipes."""
    pairs = F.filter(F.arrays_zip(headers.alias("h"), cells.alias("c")), lambda x: T.strip(T.blank(x["c"])) != "")
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["h"], F.lit(": "), T.strip(x["c"]))), " | ")


def table_text(headers: Column, rows: Column, section: Column, page: Column, kind: Column) -> Column:
    """What a table is about, for embedding: its columns and rows in words, by type."""
    names = F.when(F.size(headers) > 0, F.array_join(headers, " | ")).otherwise(F.lit("unknown columns"))
    short = F.filter(F.transform(F.slice(rows, 1, 6), lambda r: F.array_join(F.slice(F.filter(F.transform(r, T.strip), lambda c: c != ""), 1, 3), " — ")), lambda x: x != "")
    flags = F.concat_ws("\n", F.concat(F.lit("This table lists feature flag configuration options for the "), section, F.lit(" section. It has "), F.size(rows).cast("string"), F.lit(" rows with columns: "), names, F.lit(".")), F.array_join(F.transform(short, lambda x: F.concat(F.lit("Row: "), x)), "\n"))
    # fixed values: sentences that are embedded
    matrix = F.concat_ws("\n", F.concat(F.lit("This is a widget configuration matrix showing how CEM Dashboard widgets behave under different feature flag combinations. Columns: "), names, F.lit(". Total "), F.size(rows).cast("string"), F.lit(" configurations.")), F.array_join(F.filter(F.transform(F.slice(rows, 1, 5), lambda r: F.when(row_sentence(headers, r) != "", F.concat(F.lit("Config: "), row_sentence(headers, r))).otherwise("")), lambda x: x != ""), "\n"))
    every = F.filter(F.transform(rows, lambda r, i: F.when(row_sentence(headers, r) != "", F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), row_sentence(headers, r))).otherwise("")), lambda x: x != "")
    generic = F.concat_ws("\n", F.concat(F.lit("Table in section '"), section, F.lit("' on page "), page.cast("string"), F.lit(". Columns: "), names, F.lit(". Contains "), F.size(rows).cast("string"), F.lit(" data rows.")), F.array_join(every, "\n"))
    return F.when(kind == "feature_flags", flags).when(kind == "conditional_matrix", matrix).otherwise(generic)


def flag_row(headers: Column, cells: Column) -> Column:
    """Struct (description, product, applicable, feature_flags, row_id) of a row of a feature-flag table."""
    pairs = F.arrays_zip(F.transform(headers, lambda h: F.lower(T.strip(h))).alias("h"), F.transform(cells, T.strip).alias("c"))
    by = lambda words, x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x["h"], w))
    first = lambda words: F.try_element_at(F.filter(pairs, lambda x: by(words, x) & (T.blank(x["c"]) != "")), F.lit(1))["c"]
    described = F.coalesce(*[first([w]) for w in ("description", "feature", "functionality", "visibility", "name", "baseline", "cem", "utility")], F.try_element_at(F.transform(cells, T.strip), F.lit(1)), F.lit(""))
    camel = r"\b([a-z][a-zA-Z]{7,})\b"
    flagged = F.filter(pairs, lambda x: F.contains(x["h"], F.lit("flag")) & ~F.lower(T.blank(x["c"])).isin("yes", "no", "n/a", "-", ""))
    named = F.filter(F.flatten(F.transform(flagged, lambda x: F.transform(F.split(x["c"], r"[,\n]+"), T.strip))), lambda p: p.rlike(camel))
    loose = F.filter(F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(camel), F.lit(1)))), lambda w: F.lower(w).rlike("enable|allow|show|cems|ems|flag"))
    flags = F.when(F.size(named) > 0, named).otherwise(loose)
    product = F.coalesce(F.try_element_at(F.filter(pairs, lambda x: x["h"] == "product"), F.lit(1))["c"], F.lit(""))
    applies = F.coalesce(F.try_element_at(F.filter(pairs, lambda x: by(["applicable", "apply"], x)), F.lit(1))["c"], F.lit(""))
    return F.struct(described.alias("description"), product.alias("product"), applies.alias("applicable"), flags.alias("feature_flags"), T.slug(described).alias("row_id"))


#: The widgets of a matrix row: column, and words of its header, the first that fits.
WIDGETS = {"energy_widget": ["energy widget"], "carbon_widget": ["carbon widget"], "eo_widget_all_utilities": ["eo widget - all", "eo widget all", "all utilities"], "eo_widget_electricity": ["eo widget - elec", "electricity"], "eo_widget_gas": ["eo widget - gas", "gas"], "eo_widget_hot_water": ["eo widget - hot", "hot water"]}


def matrix_row(headers: Column, cells: Column, place: Column | None = None) -> Column:
    """Struct of the four conditions and six widgets of a widget-matrix row, with row_id and row_label; ``place`` (from 1) names rows without conditions."""
    pairs = F.arrays_zip(F.transform(headers, lambda h: F.lower(T.strip(h))).alias("h"), F.transform(cells, T.strip).alias("c"))
    under = lambda w: F.try_element_at(F.filter(pairs, lambda x: F.contains(x["h"], F.lit(w))), F.lit(1))["c"]
    find = lambda *words: F.coalesce(*map(under, words), F.lit(""))
    user = classify.flag_value(find("user feature flag", "user ff", "user flag", "cem user", "user widget"))
    coexist = classify.flag_value(find("coexist feature flag", "coexist ff", "coexist flag", "coexist", "coex"))
    energy = classify.baseline_value(find("energy default baseline", "energy default", "ene"))
    eo = classify.baseline_value(find("eo default baseline", "eo default"))
    named = [("user_", "User ", user), ("coexist_", "Coexist ", coexist), ("energy_", "Energy Default ", energy), ("eo_", "EO Default ", eo)]
    ident = F.concat_ws("_", *[F.when(v != "", F.concat(F.lit(a), T.slug(v))) for a, _, v in named])
    label = F.concat_ws(" | ", *[F.when(v != "", F.concat(F.lit(b), v)) for _, b, v in named])
    unnamed = lambda words: F.lit("") if place is None else F.concat(F.lit(words), place.cast("string"))
    widgets = [T.strip(find(*words)).alias(n) for n, words in WIDGETS.items()]
    return F.struct(F.when(ident != "", F.concat(F.lit("widget_"), ident)).otherwise(unnamed("widget_row_")).alias("row_id"), F.when(label != "", label).otherwise(unnamed("Widget Row ")).alias("row_label"), user.alias("user_feature_flag"), coexist.alias("coexist_feature_flag"), energy.alias("energy_default_baseline"), eo.alias("eo_default_baseline"), *widgets)


def row_chunks(tables: DataFrame) -> DataFrame:
    """A chunk of each row of the tables (source_file, page, headers, rows, section): its text by the table's type, and the matrix conditions."""
    df = tables.withColumn("table_type", classify.table_type(F.col("headers"), F.col("section")))
    df = df.select("source_file", "page", "section", "headers", "table_type", F.posexplode("rows").alias("at", "cells")).withColumn("row_index", F.col("at") + 1)
    df = df.withColumn("matrix", matrix_row(F.col("headers"), F.col("cells"), F.col("row_index"))).withColumn("flag", flag_row(F.col("headers"), F.col("cells")))
    text = F.when(F.col("table_type") == "conditional_matrix", matrix_row_text(F.col("matrix"))).when(F.col("table_type") == "feature_flags", flag_row_text(F.col("flag"))).otherwise(generic_row_text(F.col("headers"), F.col("cells")))
    conditions = [F.when(F.col("table_type") == "conditional_matrix", F.col(f"matrix.{c}")).otherwise("").alias(c) for c in ("user_feature_flag", "coexist_feature_flag", "energy_default_baseline", "eo_default_baseline")]
    return df.select("source_file", "page", "table_type", "row_index", F.lit("TABLE_ROW").alias("asset_type"), text.alias("embed_text"), *conditions)


def table_chunks(tables: DataFrame) -> DataFrame:
    """Two chunks of each parsed table (source_file, page, headers, rows, section, markdown): the whole and a fragment of 500 characters."""
    kind = classify.table_type(F.col("headers"), F.col("section"))
    df = tables.withColumn("table_type", kind).where(~F.col("markdown").isNull())
    whole = table_text(F.col("headers"), F.col("rows"), F.col("section"), F.col("page"), F.col("table_type"))
    rows = F.array(F.struct(F.lit("TABLE_ROW").alias("asset_type"), whole.alias("embed_text"), F.col("markdown").alias("display")), F.struct(F.lit("TABLE_FRAGMENT").alias("asset_type"), F.left("markdown", F.lit(500)).alias("embed_text"), F.col("markdown").alias("display")))
    return df.select("source_file", "page", "table_type", F.inline(rows))


def condition_rows(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Rows that meet every condition, whatever the case."""
    for name, value in conditions.items():
        rows = rows.where(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) == value.lower())
    return rows


def flag_row_text(row: Column) -> Column:
    """A row of a feature-flag table as a sentence."""
    flags = F.transform(row["feature_flags"], lambda f: F.concat(f, F.lit(" feature flag.")))
    parts = F.concat(F.array(F.when(row["description"] != "", F.concat(F.lit("Feature flag row for "), row["description"], F.lit("."))).otherwise("Feature flag row.")), flags, F.array(F.when(row["product"] != "", F.concat(F.lit("Product "), row["product"], F.lit(".")))), F.array(F.when(row["applicable"] != "", F.concat(F.lit("Applicable to "), row["applicable"], F.lit(".")))))
    return F.array_join(parts, " ")


def matrix_row_text(row: Column) -> Column:
    named = [("user_feature_flag", "User Feature Flag"), ("coexist_feature_flag", "Coexist Feature Flag"), ("energy_default_baseline", "Energy Default Baseline"), ("eo_default_baseline", "EO Default Baseline")]
    return F.concat_ws(" ", F.lit("Widget matrix row."), *[F.when(row[n] != "", F.concat(F.lit(f"{label} "), row[n], F.lit("."))) for n, label in named])


def generic_row_text(headers: Column, cells: Column) -> Column:
    return F.concat(F.lit("[Table Headers: "), F.array_join(headers, " | "), F.lit("]\n[Row]: "), F.array_join(cells, " | "))
