"""Embeddings and exact vector search."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab

#: Queries and items that one task meets at a time (of the mean); more are dealt into blocks, so that memory doesn't grow with the data.
QUERY_BLOCK, ITEM_BLOCK = 4096, 65_536
DIMENSIONS = 64


class EmbeddingProvider(Protocol):
    """Anything that turns texts into vectors; runs inside a pandas UDF, batch by batch."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(1 << 18)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:2], 16) % DIMENSIONS


class HashedWords:
    """Default provider: counts of tokens in 64 buckets by MD5, scaled to length 1. Needs no model or network."""

    _token = re.compile(r"[a-z0-9][a-z0-9_.\-]*")
    _stop = frozenset(vocab.STOPWORDS)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for i, t in enumerate(texts):
            for w in self._token.findall((t or "").lower()):
                if len(w) > 2 and w not in self._stop:
                    out[i, _bucket(w)] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(text: Column, provider: EmbeddingProvider | None = None) -> Column:
    """Vector of a text, blank ones as a single space."""
    own = provider or HashedWords()

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(own.embed([t if t and t.strip() else " " for t in texts])))

    return run(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column, zero: float = 1.0) -> Column:
    """Scaled to length 1; a zero vector is divided by ``zero``, so that it stays, or with NaN has no direction."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(zero)).otherwise(norm))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero as binary numbers are, not by their decimals; what rounds to zero keeps its sign."""
    scale = 10.0**digits
    return F.signum(x) * (F.round(F.abs(x) * scale) / scale)


def top_k(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, skip_equal: bool = False, match: bool = False) -> DataFrame:
    """(qid, item, score, rank): for each (qid, qvec) the k best (item, vec) by inner product.

    With ``match`` only items count whose ``bits`` hold all bits of the query's ``qbits``.

    Queries fit a block each; a block is joined to the items in Arrow batches with one matrix product, and
    every task hands on k rows per query only. The join key is the block, so neither side is collected.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    parts = max(1, items.sparkSession.sparkContext.defaultParallelism, -(-items.select("item").count() // ITEM_BLOCK))  # counted before any embedding
    items = items.where("vec IS NOT NULL")
    width = F.pmod(F.xxhash64("item"), F.lit(parts))
    left = queries.where("qvec IS NOT NULL").select("qid", "qvec", *(["qbits"] if match else []), deal.alias("block")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    right = items.select("item", "vec", *(["bits"] if match else []), width.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    local = best_pairs(left, right, ["block", "part"], k, digits, skip_equal, match)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item")))
    return ranked.where(F.col("rank") <= k)


def best_pairs(left: DataFrame, right: DataFrame, by: list[str], k: int, digits: int = 6, skip_equal: bool = False, match: bool = False) -> DataFrame:
    """(qid, item, score): where queries (qid, qvec) and items (item, vec) of one group meet, the k best items of each query; one matrix product a group."""
    kinds = {n: t for n, t in left.select("qid").dtypes + right.select("item").dtypes}

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", a.schema.field("qid").type), ("item", b.schema.field("item").type), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        b = b.sort_by("item")  # equal scores then come in order
        own, names, asked, rows = a.column("qid").to_pylist(), b.column("item"), matrix(a.column("qvec"), a.num_rows), matrix(b.column("vec"), b.num_rows)
        items, need = names.to_pylist() if skip_equal else None, min(b.num_rows, k + skip_equal)
        asks, has = (a.column("qbits").to_numpy(), b.column("bits").to_numpy()) if match else (None, None)
        at, of, scores = [], [], []
        for first in range(0, len(asked), 256):
            for i, s in enumerate(np.round(asked[first : first + 256] @ rows.T, digits), first):
                if match:
                    s = np.where(has & asks[i] == asks[i], s, -np.inf)
                enough = np.flatnonzero(s >= np.partition(s, len(s) - need)[len(s) - need])
                best = enough[np.argsort(-s[enough], kind="stable")]
                if match:
                    best = best[np.isfinite(s[best])]
                if skip_equal:
                    best = best[[items[j] != own[i] for j in best]]
                best = best[:k]
                at.append(best)
                of.append(np.full(len(best), i))
                scores.append(s[best])
        return pa.table([a.column("qid").take(pa.array(np.concatenate(of))), names.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], schema=schema)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"qid {kinds['qid']}, item {kinds['item']}, score double")


def merge_best(hits: DataFrame, key: str = "item", by: tuple[str, ...] = ("score", "qpos")) -> DataFrame:
    """Of the hits of several queries the best row for each key: highest score, then first query."""
    w = Window.partitionBy(key).orderBy(F.desc(by[0]), by[1])
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def reciprocal_rank_fusion(ranks: DataFrame, first: str = "dense_rank", second: str = "bm25_rank") -> DataFrame:
    """Adds rrf = 1/(60 + first rank) + 1/(60 + second rank), to six digits."""
    return ranks.withColumn("rrf", F.round(1 / (F.lit(float(vocab.RRF)) + F.col(first)) + 1 / (F.lit(float(vocab.RRF)) + F.col(second)), 6))
