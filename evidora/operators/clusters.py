"""Exact vector search that leaves out clusters which can't hold a hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors


def centers_of(sample: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from seeds drawn by squared distance; the same sample gives the same centers."""
    rng = np.random.default_rng(1)
    centers, far = sample[:1], ((sample - sample[0]) ** 2).sum(1)
    while len(centers) < min(clusters, len(sample)) and far.sum() > 0:
        centers = np.vstack([centers, sample[rng.choice(len(sample), p=far / far.sum())]])
        far = np.minimum(far, ((sample - centers[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest(sample, centers)[0]
        centers = np.vstack([sample[own == j].mean(0) if (own == j).any() else centers[j] for j in range(len(centers))])
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest center."""
    squares = (rows**2).sum(1)[:, None] - 2 * rows @ centers.T + (centers**2).sum(1)[None]
    own = squares.argmin(1)
    return own, np.linalg.norm(rows - centers[own], axis=1)


class ClusteredVectors:
    """(item, vec) by clusters. Centers are fitted on at most ``sample`` rows (the first by a hash of the item), and every row belongs to the nearest.

    A query scores the clusters nearest to it first, until they hold k items. By the triangle inequality no item of a cluster scores above
    q.c + |q| * radius; the second pass goes to those clusters only whose bound reaches the k-th score so far. So results equal those of a search of
    everything, and how much is scored depends on how clustered the vectors are. Large clusters are cut into blocks.

    The model on the driver and in tasks is one center, radius and size a cluster, of which there are ``clusters`` at most.
    """

    def __init__(self, items: DataFrame, clusters: int = 64, sample: int = 8192):
        items = items.where("vec IS NOT NULL AND size(vec) > 0")
        drawn = items.select("vec", "item", F.xxhash64("item").alias("h")).orderBy("h", "item").limit(sample).collect()
        self.centers = centers = centers_of(np.array([r["vec"] for r in drawn], float), clusters) if drawn else np.zeros((0, 1))

        @F.pandas_udf("struct<cluster:int,off:double>")
        def place(vecs: pd.Series) -> pd.DataFrame:
            own, off = nearest(np.stack([np.asarray(v, float) for v in vecs]), centers)
            return pd.DataFrame({"cluster": own.astype("int32"), "off": off})

        self.items = items.select("item", "vec", place("vec").alias("at")).select("item", "vec", "at.cluster", "at.off") if drawn else items.select("item", "vec", F.lit(0).alias("cluster"), F.lit(0.0).alias("off")).limit(0)
        facts = {r["cluster"]: r for r in self.items.groupBy("cluster").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}
        self.sizes = np.array([facts[j]["n"] if j in facts else 0 for j in range(len(centers))], int)
        self.radius = np.array([facts[j]["radius"] if j in facts else 0.0 for j in range(len(centers))], float)

    def _visits(self, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """(qid, qvec, cluster, part, n) of the first pass, or of the second where queries carry ``least``, the k-th score of the first."""
        centers, sizes, radius, block = self.centers, self.sizes, self.radius, vectors.ITEM_BLOCK
        second = "least" in queries.columns
        kind = dict(queries.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches if len(centers) else ():
                at, cluster, part = [], [], []
                for i, vec in enumerate(b.column(1).to_pylist()):
                    q = np.asarray(vec, float)
                    near = centers @ q
                    order = np.argsort(-near, kind="stable")
                    first = order[: int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1]
                    chosen = first
                    if second:
                        least = b.column(2)[i].as_py()
                        reach = near + np.linalg.norm(q) * radius * (1 + 1e-9) + 1e-9
                        chosen = np.setdiff1d(np.flatnonzero(reach >= (-np.inf if least is None else least - 10.0**-digits)), first)
                    for j in chosen[sizes[chosen] > 0]:
                        for p in range(-(-int(sizes[j]) // block)):
                            at.append(i)
                            cluster.append(int(j))
                            part.append(p)
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array([int(sizes[j]) for j in cluster], pa.int64())], ["qid", "qvec", "cluster", "part", "n"])

        columns = ["qid", "qvec", *(["least"] if second else [])]
        return queries.select(*columns).mapInArrow(run, f"qid {kind['qid']}, qvec {kind['qvec']}, cluster int, part int, n bigint")

    def _score(self, visits: DataFrame, k: int, digits: int, skip_equal: bool) -> DataFrame:
        if not len(self.centers):
            return visits.select("qid", F.lit(None).cast(dict(self.items.dtypes)["item"]).alias("item"), F.lit(0.0).alias("score")).limit(0)
        parts = F.element_at(F.create_map(*[x for j, n in enumerate(self.sizes) for x in (F.lit(j), F.lit(max(1, -(-int(n) // vectors.ITEM_BLOCK))))]), F.col("cluster"))
        blocks = max(1, -(-visits.select("qid").distinct().count() // vectors.QUERY_BLOCK))
        left = visits.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        right = self.items.withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return vectors.best_pairs(left, right, ["cluster", "part", "block"], k, digits, skip_equal)

    def search(self, queries: DataFrame, k: int, digits: int = 6, skip_equal: bool = False) -> DataFrame:
        """(qid, item, score, rank), as ``vectors.top_k`` has it for (qid, qvec)."""
        queries = queries.where("qvec IS NOT NULL").select("qid", "qvec")
        first = self._score(self._visits(queries, k + skip_equal, digits), k, digits, skip_equal)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "item")
        least = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        second = self._score(self._visits(queries.join(least, "qid", "left"), k + skip_equal, digits), k, digits, skip_equal)
        return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def scored(self, queries: DataFrame, k: int, digits: int = 6, skip_equal: bool = False) -> float:
        """Share of all pairs of queries and items that a search scores."""
        queries = queries.where("qvec IS NOT NULL").select("qid", "qvec")
        visits = self._visits(queries, k + skip_equal, digits)
        first = self._score(visits, k, digits, skip_equal)
        least = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item"))).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        more = self._visits(queries.join(least, "qid", "left"), k + skip_equal, digits)
        met = visits.unionByName(more).where("part = 0").agg(F.sum("n")).first()[0] or 0
        return met / max(1, queries.count() * int(self.sizes.sum()))
