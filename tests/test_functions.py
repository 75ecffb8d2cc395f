import pytest
from pyspark.sql import functions as F

from evidora.functions import classify, ids
from evidora.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or ("",)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def test_ids(spark):
    assert one(spark, ids.stable_id(F.lit("a.pdf"), F.lit(3), prefix="pg_")) == "pg_4fb96effaea1bd6f"
    assert one(spark, ids.point_id(F.lit("a.pdf"), F.lit("hello"))) == "745513ff-e185-359a-9cbf-37c44d604ddb"
    assert one(spark, ids.point_id(F.lit("EVD-1000::fix_chunk"))) == "db28b0e1-39cd-cb70-22f2-ca411a28af0c"


def test_tokens_and_keys(spark):
    assert one(spark, T.tokens(F.lit("How to fix EOM publish v1.2?"))) == ["fix", "eom", "publish", "v1.2"]
    assert one(spark, T.issue_keys(F.lit("see abc-12, ABC-12 and x-1"))) == ["ABC-12"]
    assert one(spark, T.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("text", "masked"), [
    ("mail a.b@c.org now", "mail [email] now"), ("see https://x.org/a?b", "see [url]"), ("at 10.0.0.1 it", "at [ip] it"), ("call +1 555 123 4567 please", "call [phone] please"),
    ("key abcdefabcdefabcdefabcdefabcdefabcd1234 end", "key [token] end"), ("ABCDEFGHABCDEFGHABCDEFGHABCDEFGH-1234 stays", "ABCDEFGHABCDEFGHABCDEFGHABCDEFGH-1234 stays"), ("x ![i](y.png) z", "x z"),
    ("id 01234567-89ab-cdef-0123-456789abcdef", "id [id]"), ("", ""),
])
def test_mask(spark, text, masked):
    assert one(spark, T.mask(F.lit(text))) == masked


def test_clean(spark):
    assert one(spark, T.clean(F.lit("*Bold* [text|http://x] {code} done"))) == "Bold text done"


@pytest.mark.parametrize(("question", "intent"), [("hello", "GENERAL_HELP"), ("similar defects for login", "SIMILAR_DEFECTS"), ("ABC-123 root cause", "DEFECT_BY_KEY"), ("asset sync", "DEFECT_DIAGNOSTIC"), ("", "GENERAL_HELP")])
def test_intent(spark, question, intent):
    assert one(spark, classify.intent(F.lit(question))) == intent


@pytest.mark.parametrize(("question", "route"), [("show the full table", "table_full"), ("how to upload data", "text_section"), ("feature flag list", "feature_flag_table"), ("opening hours", "hybrid")])
def test_route(spark, question, route):
    assert one(spark, classify.doc_route(F.lit(question))) == route


def test_conditions(spark):
    q = F.lit("user feature flag is enabled, energy default baseline no")
    assert one(spark, classify.conditions(q)) == {"user_feature_flag": "Enabled", "energy_default_baseline": "No"}
    assert one(spark, classify.missing_conditions(q)) == ["coexist_feature_flag", "eo_default_baseline"]


@pytest.mark.parametrize(("question", "out"), [("can you please tell me about the flags", "The flags"), ("Onboarding Steps Include:", "What are the onboarding Steps?"), ("don't  stop", "Do not stop")])
def test_normalize(spark, question, out):
    assert one(spark, T.normalize_question(F.lit(question))) == out


def test_quality_and_status(spark):
    yes, some = F.lit(True), F.lit("x" * 50)
    assert one(spark, classify.quality(some, some, yes, some, some, yes, some, yes, F.lit(False))) == 1.0
    assert one(spark, classify.quality(some, some, F.lit(False), F.lit(""), F.lit(""), yes, F.lit(""), F.lit(False), yes)) == 0.15
    assert one(spark, classify.is_fixed(F.lit("Closed"), F.lit("Duplicate"))) and one(spark, classify.is_cancelled(F.lit("Closed"), F.lit("Duplicate")))


def test_error_signature_and_sentences(spark):
    assert one(spark, T.error_signature(F.lit("Timeout! timeout again, 403 Forbidden and a NullPointerException"))) == "Timeout; 403 Forbidden; NullPointerException"
    assert one(spark, T.first_sentence_with(F.lit("Nothing here at all. It was fixed by a rerun! More."), ["fixed"])) == "It was fixed by a rerun!"


def test_values(spark):
    assert one(spark, classify.flag_value(F.lit("Enabl ed"))) == "Enabled" and one(spark, classify.baseline_value(F.lit("disabled"))) == "No"
    assert one(spark, T.section_id(F.lit("1.1.1 Feature Options"))) == "1.1.1" and one(spark, T.slug(F.lit("A b-C!"))) == "a_b_c"
    assert one(spark, T.without_no_answer(F.lit("It does not mention that."))) == "The documentation does not contain a solution for this."
