"""Embedding providers: one after the other, in batches, at a rate, and only for texts that are new."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .upsert import KeyedTable
from .vectors import EmbeddingProvider, HashedWords, embed

BATCH = 64


class Chain:
    """The first provider that answers counts; each gets ``BATCH`` texts at a time, and at most ``per_minute`` calls a minute from one worker.

    A provider that raises is passed over for that batch only, so that a lost connection costs no batch and a provider that comes back is used
    again. Vectors of different providers must have one dimension; another one is an error of the provider. The last provider's error is the chain's. It is
    sent to the workers as it is, so providers hold settings, not connections.
    """

    def __init__(self, *providers: EmbeddingProvider, batch: int = BATCH, per_minute: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.batch, self.pause = providers or (HashedWords(),), batch, 60.0 / per_minute if per_minute else 0.0
        self._clock, self._sleep, self._next = clock, sleep, 0.0

    def _call(self, provider: EmbeddingProvider, texts: list[str], width: int | None) -> np.ndarray:
        if self.pause and not isinstance(provider, HashedWords):
            now = self._clock()
            if now < self._next:
                self._sleep(self._next - now)
            self._next = max(now, self._next) + self.pause
        got = np.asarray(provider.embed(texts), float)
        if got.ndim != 2 or len(got) != len(texts) or (width and got.shape[1] != width):
            raise ValueError(f"{type(provider).__name__} gave vectors of shape {got.shape} for {len(texts)} texts")
        return got

    def embed(self, texts: list[str]) -> np.ndarray:
        parts: list[np.ndarray] = []
        for at in range(0, len(texts), self.batch):
            some, failed = texts[at : at + self.batch], None
            for provider in self.providers:
                try:
                    parts.append(self._call(provider, some, parts[0].shape[1] if parts else None))
                    break
                except Exception as wrong:  # whatever a provider raises, the next one is asked
                    failed = wrong
            else:
                raise failed
        return np.vstack(parts) if parts else np.zeros((0, 1))


class EmbeddedTexts:
    """Vectors by the SHA-256 of their texts, so that only texts never seen are embedded, each once, whatever rows they stand in."""

    def __init__(self, spark: SparkSession, path: str, provider: EmbeddingProvider | None = None, buckets: int = 16):
        self.provider = provider
        self.table = KeyedTable(spark, path, "hash string, vec array<double>", ["hash"], buckets=buckets)

    def add(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``vec``. Texts that are new are embedded and stored first; blank ones count as one blank."""
        words = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", " ").otherwise(F.col(text))
        named = rows.withColumn("__hash", F.sha2(words, 256))
        fresh = named.select(F.col("__hash").alias("hash"), words.alias("__text")).dropDuplicates(["hash"]).join(self.table.read().select("hash"), "hash", "left_anti")
        self.table.apply(fresh.repartition("hash").select("hash", embed(F.col("__text"), self.provider).alias("vec")))
        return named.join(self.table.read().withColumnRenamed("hash", "__hash"), "__hash", "left").drop("__hash")
