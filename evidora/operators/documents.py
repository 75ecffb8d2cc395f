"""Paginated Markdown documents: elements, headings, sections and chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.page_parts import page_parts
from .along import BLOCK, along

# fixed values: lines of contents pages, when documents come in and when chunks are shown
TOC_LINE = r"^[\s.·…\-_]{5,}\s*\d{0,4}\s*$|^\d{1,4}\s*$"
TOC_ENTRY = r"^.*[.…·]{4,}\s*\d+\s*$"


def lines(c: Column) -> Column:
    """The stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(T.blank(c), r"\r?\n"), T.strip), lambda x: x != "")


def toc_share(c: Column) -> Column:
    """Share of lines that look like a table of contents; 1 without any line."""
    dots = lambda x: F.char_length(x) - F.char_length(F.regexp_replace(x, "[.·…]", ""))
    like = F.filter(lines(c), lambda x: (dots(x) > F.char_length(x) * 0.4) | x.rlike(TOC_LINE))
    return F.when(F.size(lines(c)) == 0, F.lit(1.0)).otherwise(F.size(like) / F.size(lines(c)))


def is_toc(c: Column, above: float = 0.7) -> Column:
    return toc_share(c) > above


def is_page_header(c: Column, patterns: list[str]) -> Column:
    """Whether every line is a running header, footer or page number; ``patterns`` name a document's own headers."""
    whole = "(?i)^(" + "|".join([*patterns, r"\d{1,3}"]) + ")$"
    return F.forall(lines(c), lambda x: x.rlike(whole))


def is_screenshot_table(c: Column) -> Column:
    """Tables that are read off screenshots: two words of a user interface or of a file browser."""
    low = F.lower(T.blank(c))
    count = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    return (F.size(lines(c)) >= 2) & ((count(vocab.SCREENSHOT_WORDS) >= 2) | (count(vocab.FILE_BROWSER_WORDS) >= 2))


def split_pages(pages: DataFrame) -> DataFrame:
    """(source_file, page, ord, element_type, content) of (source_file, page, markdown): text and tables in reading order.

    Cutting a page needs its lines in order only, so this is one Arrow pass.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(source, page, n, kind, content) for source, page, md in zip(f["source_file"], f["page"], f["markdown"]) for n, (kind, content) in enumerate(page_parts(md))]
            yield pd.DataFrame(rows, columns=["source_file", "page", "ord", "element_type", "content"])

    return pages.select("source_file", "page", "markdown").mapInPandas(run, "source_file string, page bigint, ord int, element_type string, content string")


def heading_fill(elements: DataFrame, order: list[str], blocks: bool = True) -> DataFrame:
    """Adds h1, h2 (the headings in force) from h1_here and h2_here: a new h1 ends the h2 before it. ``blocks``: see ``along``."""
    df = along(elements, order, upto={x: _heading(x, order) for x in ("h1", "h2")}, blocks=blocks)
    kept = F.when(F.col("h1").isNull() | (F.col("h2.place") >= F.col("h1.place")), F.col("h2.t"))
    return df.withColumns({"h1": F.col("h1.t"), "h2": kept})


def _heading(level: str, order: list[str]) -> Column:
    """A heading that begins here, with its place, by which levels are told apart."""
    return F.when(F.col(f"{level}_here").isNotNull(), F.struct(F.struct(*order).alias("place"), F.col(f"{level}_here").alias("t")))


def heading_levels(elements: DataFrame, order: list[str], levels: tuple[str, ...] = ("h1", "h2", "h3")) -> DataFrame:
    """Adds each level's heading in force (from ``<level>_here``), which a new one of any higher level ends, section_title and parent_path."""
    df = along(elements, order, upto={x: _heading(x, order) for x in levels})
    above = [F.array_max(F.array(*[F.col(f"{y}.place") for y in levels[:i]])) if i else F.lit(None) for i in range(len(levels))]
    df = df.withColumns({x: F.when(a.isNull() | (F.col(f"{x}.place") >= a), F.col(f"{x}.t")) for x, a in zip(levels, above)})
    there = F.filter(F.array(*levels), lambda h: T.blank(h) != "")
    return df.withColumn("section_title", F.coalesce(F.try_element_at(there, F.lit(-1)), F.lit(""))).withColumn("parent_path", F.array_join(there, " > "))


#: Names under which elements leave for readers of the plain form, besides those that stay.
PLAIN_NAMES = {"h1": "heading_h1", "h2": "heading_h2", "h3": "heading_h3"}


def plain_elements(elements: DataFrame) -> DataFrame:
    """The flat form of elements: headings under their long names, the page number under both of its names."""
    renamed = elements.withColumnsRenamed(PLAIN_NAMES)
    return renamed.withColumn("llamaparse_page_number", F.col("pdf_page_number"))


def drop_toc_chunks(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Without chunks of which over half the lines lead by dots to a page number; empty ones stay."""
    found = lines(F.col(text))
    return chunks.where(F.size(F.filter(found, lambda x: x.rlike(TOC_ENTRY))) * 2 <= F.size(found))


def snippets(elements: DataFrame, order: list[str], n: int = 400) -> DataFrame:
    """Adds preceding_text and following_text: the end of the nearest text before, the start of the nearest after."""
    end, start = (F.when(F.col("element_type") == "TEXT", cut(F.col("content"), n)) for cut in (T.last_chars, T.first_chars))
    return along(elements, order, before={"preceding_text": end}, after={"following_text": start}).fillna("", ["preceding_text", "following_text"])


def merge_sections(elements: DataFrame, order: list[str], blocks: bool = True) -> DataFrame:
    """Neighbouring texts under one parent heading become one: (source_file, section, element_type, page, page_end, n, content).

    Gaps and islands: a new island begins at every table, after one, and where the parent changes or is empty.
    """
    parent = F.coalesce(F.nullif("h2", F.lit("")), F.nullif("h1", F.lit("")), F.lit(""))
    df = along(elements.withColumn("section", parent), order, before={"__last": F.struct("element_type", "section")}, blocks=blocks)
    same = (F.col("element_type") == "TEXT") & (F.col("__last.element_type") == "TEXT") & (F.col("section") == F.col("__last.section")) & (F.col("section") != "")
    df = along(df, order, sums={"island": F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)}, blocks=blocks)
    page = "pdf_page_number" if "pdf_page_number" in df.columns else "page"
    grouped = df.groupBy("source_file", "island").agg(F.first("section").alias("section"), F.first("element_type").alias("element_type"), F.min(page).alias("page"), F.max(page).alias("page_end"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("place"), "content"))).alias("parts"))
    return grouped.withColumn("content", F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n")).drop("parts")


def sequence_ids(chunks: DataFrame, order: list[str], blocks: bool = True) -> DataFrame:
    """Adds sequence_id within each file: texts first, then table rows and fragments, then whole tables. ``blocks``: see ``along``."""
    phase = F.when(F.col("element_type") == "TEXT", 0).when(F.col("element_type") == "TABLE_FULL", 2).otherwise(1)
    df = along(chunks.withColumn("__phase", phase), ["__phase", *order], sums={"sequence_id": F.lit(1)}, block=F.struct("__phase", F.floor(F.col(order[0]) / BLOCK)) if blocks else None, blocks=blocks)
    return df.withColumn("sequence_id", F.col("sequence_id").cast("int")).drop("__phase")


def split_recursively(text: str, size: int = vocab.PART_SIZE, overlap: int = vocab.PART_OVERLAP, separators: list[str] = vocab.SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters, cut at the coarsest separator that does, neighbours sharing up to ``overlap``."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    pieces: list[str] = list(text) if separator == "" else [p + separator for p in text.split(separator)[:-1]] + [text.split(separator)[-1]]
    parts: list[str] = []
    window: deque[str] = deque()
    held = 0
    for piece in filter(None, pieces):
        if len(piece) > size and finer:
            if window:
                parts.append("".join(window))
                window, held = deque(), 0
            parts += split_recursively(piece, size, overlap, finer)
            continue
        if window and held + len(piece) > size:
            parts.append("".join(window))
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        parts.append("".join(window))
    return [p.strip() for p in parts if p.strip()]


def section_chunks(sections: DataFrame, header_patterns: list[str] | None = None) -> DataFrame:
    """Text chunks of merged sections: whole up to 3,500 characters, else parts; contents, headers and stubs are left out."""
    body = T.strip(F.regexp_replace("content", "#+ ", ""))
    kept = sections.where((F.col("element_type") == "TEXT") & ~is_toc(F.col("content")) & (F.char_length(body) >= 50))
    if header_patterns:
        kept = kept.where(~is_page_header(body, header_patterns))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t) if len(t) > vocab.SECTION_LIMIT else [t])

    info = F.when(F.col("page") == F.col("page_end"), F.col("page").cast("string")).otherwise(F.concat_ws("-", "page", "page_end"))
    parts = kept.select("source_file", "island", "section", info.alias("page_info"), F.posexplode(cut(T.strip(F.col("content")))).alias("part", "display"), F.char_length(T.strip(F.col("content"))).alias("n_chars"))
    kind = F.when(F.col("n_chars") > vocab.SECTION_LIMIT, "section_part").otherwise("section_full")
    embed = F.concat_ws("\n", F.when(F.col("section") != "", F.concat(F.lit("Section: "), T.section_title(F.col("section")), F.lit("."))), F.concat(F.lit("Source: "), "source_file", F.lit(", Page "), "page_info", F.lit(".")), F.col("display"))
    return parts.withColumn("chunk_type", kind).withColumn("embed_text", embed)
