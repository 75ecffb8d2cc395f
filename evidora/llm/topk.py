"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments, each with its mean and deviation. For two vectors, the
inner product within a segment is at most ``len * mean * mean + dev * dev`` (``dev`` the norm of
what is left of the segment without its mean), so the sums bound the product from above, which for
fixed norms is the same as bounding the distance from below. Bounds go from coarse to fine; only
what still may reach a query's k-th best so far is computed exactly, in integers.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part;
vectors of another length than the query's aren't compared with it; ties go to the smaller id;
a query never finds its own row, and with repeated ids no row of the same id; fewer than k others give fewer ranks;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS = (1, 4, 16)
#: Rows (of the mean) of a block of queries and of candidates; rows of queries compared at a time.
QUERY_BLOCK, CANDIDATE_BLOCK, AT_ONCE = 2048, 16_384, 64


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def statistics(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the square root of the segment's length, and deviations: both as coordinates of a bound."""
    means, devs = [], []
    for part in np.array_split(rows, min(segments, rows.shape[1]), axis=1):
        m = part.mean(1)
        means.append(m * np.sqrt(part.shape[1]))
        devs.append(np.sqrt(np.square(part - m[:, None]).sum(1)))
    return np.stack(means, 1), np.stack(devs, 1)


def top_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores): for each query its k best rows, exactly; whole numbers held as doubles."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    levels = [(np.hstack(statistics(queries, n)), np.hstack(statistics(rows, n))) for n in SEGMENTS]
    slack = 1e-9 * (1 + np.abs(queries).sum(1).max(initial=0) * np.abs(rows).max(initial=0))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(queries), AT_ONCE):
        q, qi = queries[first : first + AT_ONCE], query_ids[first : first + AT_ONCE]
        bound = levels[0][0][first : first + AT_ONCE] @ levels[0][1].T
        bound[qi[:, None] == ids[None, :]] = -np.inf
        # A first floor for each query: exact products of the rows with the best coarse bounds.
        some = min(len(ids), 8 * k)
        seed = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        exact = np.einsum("qd,qsd->qs", q, rows[seed])
        exact[np.take_along_axis(bound, seed, 1) == -np.inf] = -np.inf
        floor = np.sort(exact, 1)[:, -k] if some >= k else np.full(len(q), -np.inf)
        alive = bound >= floor[:, None] - slack
        alive[bound == -np.inf] = False
        for n in (1, 2):
            if alive.mean() < 0.3:
                a, b = np.nonzero(alive)
                for i in range(0, len(a), 1 << 17):
                    x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
                    fine = np.einsum("ij,ij->i", levels[n][0][first + x], levels[n][1][y])
                    alive[x, y] = fine >= floor[x] - slack
            else:
                alive &= levels[n][0][first : first + AT_ONCE] @ levels[n][1].T >= floor[:, None] - slack
        for j in range(len(q)):
            left = np.flatnonzero(alive[j])
            score = rows[left] @ q[j]
            best = np.argsort(-score, kind="stable")[:k]  # rows are in order of ids, so ties are too
            out.append((np.full(len(best), qi[j]), ids[left[best]], score[best].astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, embedding).

    Queries are the rows whose id is divisible by ``every``. Queries and candidates are dealt into
    blocks by a hash of the id; each pair of blocks is one task's work and gives k rows a query.
    """
    base = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantized(F.col("embedding"), scale).alias("v"))
    asked = base.where(F.col("vec_id") % every == 0)
    n, m = base.count(), asked.count()
    blocks, groups = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(count)).cast("int")
    to = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asked.select("vec_id", "v", dealt(blocks).alias("qb")).select("*", to(groups).alias("cb"), F.size("v").alias("d"))
    right = base.select("vec_id", "v", dealt(groups).alias("cb")).select("*", to(blocks).alias("qb"), F.size("v").alias("d"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        q, x = (np.reshape(t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64), (t.num_rows, -1)) if t.num_rows else None for t in (a, b))
        if q is None or x is None:
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = top_of_block(a.column("vec_id").to_numpy(), q, b.column("vec_id").to_numpy(), x, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    key = ["qb", "cb", "d"]
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
