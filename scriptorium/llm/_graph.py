"""Connected components by contraction, with all state in distributed tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import joined_by_group, written


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of ``edges`` (a, b: long).

    Each round joins every vertex to its smallest neighbour, shortens the chains this makes,
    and contracts; only roots that still have edges go on, so few rounds are needed. Most vertices may have one parent, so
    parents are looked up once each and joined by group.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    total = labels.count()
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("p"))
        up = written(up, "parents")
        while True:
            parents = up.groupBy("p").agg(F.count("*").alias("n")).join(up.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p")
            shorter = written(joined_by_group(up, parents, "p", "n", total).select("v", "pp", (F.col("pp") != F.col("p")).alias("moved")), "parents")
            moved = not shorter.where("moved").isEmpty()
            up = shorter.select("v", F.col("pp").alias("p"))
            if not moved:
                break
        sizes = labels.groupBy("component").agg(F.count("*").alias("n")).join(up.select(F.col("v").alias("component"), "p"), "component")
        labels = written(joined_by_group(labels, sizes, "component", "n", total).select("id", F.coalesce("p", "component").alias("component")), "labels")
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = written(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels


class Union:
    """Union-find over 0 .. n - 1 within a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], dtype=np.int64)
