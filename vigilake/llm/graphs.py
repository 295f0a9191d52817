"""Connected components of links as joins and aggregates, and union-find inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import stash


class Union:
    """Union-find over 0 ... n - 1; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return int(a)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): smallest node reachable, for every node of ``links`` (a, b).

    Each round gives a node the smallest label among its neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of the longest path. Labels are written to the shared folder every round. A node
    with many links is a key of a plain join, which Spark splits, and of sums with map-side combine.
    """
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), "l")
    labels = stash(labels, label)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("l").alias("_l")).hint("merge"), "b").groupBy("a").agg(F.min("_l").alias("_near"))
        lower = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", "l", F.least("l", "_near").alias("_next"))
        jumped = stash(
            lower.join(labels.select(F.col("node").alias("_next"), F.col("l").alias("_jump")).hint("merge"), "_next", "left")
            .select("node", F.col("l").alias("_old"), F.least("_next", F.coalesce("_jump", "_next")).alias("l")), label)
        labels = jumped.select("node", "l")
        if jumped.filter(F.col("_old") != F.col("l")).limit(1).count() == 0:
            return labels.select("node", F.col("l").alias("component"))
