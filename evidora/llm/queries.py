"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, extraction, interaction, langid, mixing, repeats, secrets, simhash, topk, toxicity, unigram, winnowing
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of ids and bytes for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are."""
    return winnowing.compare_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: the fixed patterns and what the field adds."""
    return secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.train())


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 400-byte strings that also start elsewhere."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated factor of each document, its probability of being kept, and the decision."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    name = lambda c: F.coalesce(f"row.{c}", F.lit("")).alias(c)
    return found.select("row.doc_id", name("source"), name("lang"), "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the toxic label for each document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the unigram reading of the public piece vocabulary."""
    return unigram.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract_pages(table(spark, sf_dir, "pages"), extraction.train())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of four-word shingles and the near-copy component of each document."""
    found = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, radius=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth one."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language are apart, and the terms that set each apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders for every source, with their Shapley values."""
    return interaction.audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the dictionary that compresses it best."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs))


QUERIES = {"op1_bpe": op1_bpe, "op2_winnowing": op2_winnowing, "op3_secrets": op3_secrets, "op4_repeats": op4_repeats, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_unigram": op7_unigram, "op8_extraction": op8_extraction, "op9_simhash": op9_simhash, "op10_topk": op10_topk, "op11_divergence": op11_divergence, "op12_interaction": op12_interaction, "op13_language": op13_language}
ORACLE_SQL: dict[str, str] = {"op5_mixing": mixing.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL, "op11_divergence": divergence.ORACLE_SQL, "op12_interaction": interaction.ORACLE_SQL}
