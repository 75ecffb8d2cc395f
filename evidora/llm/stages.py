"""Operators as stages: documents in, documents out.

All columns of the input pass through unchanged and in order, whatever their names; only ``text`` is
replaced by the masking stage (and ``n_chars``, where there is one, follows it). Nulls stay null. The last stage,
``encode``, keeps doc_id, lang and source and encodes a null text as the empty one.

Defined cases: repeated rows are near copies of each other, of which one stays; of equally small ids the near-copy stage keeps one by the text; very
long texts are read whole; an empty table stays empty; without labels no document is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, mixing, secrets, simhash, toxicity
from .common import map_texts, text_slices


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose text isn't called toxic. The model learns from the labelled rows that aren't held out."""
    model, at = toxicity.fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield b.filter(pa.array([model.score(t or "") < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return map_texts(docs, run, docs.schema)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: five words, likeness 0.8. Sets so alike differ in 10 of 64 bits on average, and in over 18 hardly ever."""
    return simhash.one_of_each(docs, words=5, radius=18, likeness=0.8)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Every row, each span of a secret replaced by a mark."""
    field, at = secrets.train(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = pa.array([secrets.mask_text(t, field) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns)], b.schema.names)

    masked = map_texts(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return masked


def sample_mixture(docs: DataFrame) -> DataFrame:
    """Rows drawn by the calibrated probabilities."""
    return mixing.mix(docs).where("kept = 1").select("row.*")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, token_ids)."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, pattern, keep=True, with_ids=True).drop("text")
