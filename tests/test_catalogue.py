import pytest

import __spark_entry__ as entry
from evidora.plans import catalogue
from tests.oracle import check

WITH = sorted(catalogue.oracle_sql())
#: Held against plain Python in test_plain.py.
PLAIN = set("mask_phone clean_text first_sentence_with_cue defect_normalize issue_chunks rich_text_flatten key_lookup_similar answers query_normalize section_chunks page_split table_chunks relative_times evidence_prompts reading_context".split())


@pytest.mark.parametrize("name", WITH)
def test_query_equals_its_sql(spark, small, name):
    check(spark, name, small, entry)


def test_every_query_has_sql_or_a_plain_version():
    assert set(catalogue.queries()) == set(WITH) | PLAIN


def test_entry(spark):
    assert entry.entry(spark).count() > 0
