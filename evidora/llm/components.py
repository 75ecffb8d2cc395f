"""Connected components of links, as DataFrame rounds with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b); the component is its smallest node.

    Each round takes the smallest label among the neighbours and then follows that label once
    (pointer jumping), so that chains shorten by half. Labels are aggregated with partial sums, and
    the joins stay open to splitting of skewed keys, as a hub may hold a third of all links.
    No link: no rows. Loops and repeated links are harmless; null ends are ignored.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        lower = materialize(lower)
        labels = lower.select("node", "label")
        if lower.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
