"""Functions that give tables, for SQL: pages cut into elements, answers cut into sections.

    SELECT * FROM document_elements(TABLE(SELECT source_file, page, markdown FROM pages) PARTITION BY source_file ORDER BY page)
    SELECT a.id, s.* FROM answers a, LATERAL answer_sections(a.answer, array('root causes')) s
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .page_parts import page_parts, sections_of


@udtf(returnType="source_file string, page bigint, ord int, element_type string, content string")
class DocumentElements:
    """Texts and tables of one document in reading order, numbered through all its pages. Takes (source_file, page, markdown), a file a partition, in order of page."""

    def __init__(self):
        self.n = 0

    def eval(self, row: Row):
        for kind, content in page_parts(row["markdown"]):
            yield row["source_file"], row["page"], self.n, kind, content
            self.n += 1


@udtf(returnType="place int, title string, section string")
class AnswerSections:
    """The sections of a Markdown answer whose headings hold one of the wanted titles, in order; without wanted titles none."""

    def eval(self, answer: str, wanted: list):
        for place, (title, section) in enumerate(sections_of(answer, wanted), 1):
            yield place, title, section


def register(spark: SparkSession) -> None:
    spark.udtf.register("document_elements", DocumentElements)
    spark.udtf.register("answer_sections", AnswerSections)
