"""Connected components by alternating large-star and small-star steps.

The method of Kiveris et al., "Connected Components in MapReduce and Beyond"
(2014): each step rewires edges towards the smallest neighbour, and the edge
set ends as one star for each component.  Every round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, root) for every node with an edge to another.

    ``root`` is the smallest node of the component.  Loops, repeated edges and
    edges with a null end add nothing.  Raises if MAX_ROUNDS rounds don't
    converge; it never returns a partial answer.
    """
    spark = edges.sparkSession
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct()
    before, kept = None, []
    own = Window.partitionBy("u")
    for _ in range(MAX_ROUNDS):
        path = scratch(spark, "components")
        now.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        for old in kept:
            discard(spark, old)
        kept = [path]
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct().unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(own))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # dealt by u, repeats fall away and the smallest neighbour is found without another shuffle
        small = large.repartition("u").distinct().withColumn("m", F.min("v").over(own))
        now = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    raise RuntimeError(f"components did not converge in {MAX_ROUNDS} rounds")


class Forest:
    """Union-find over 0..n-1 that tells which unions joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.up
        at = up[nodes]
        while True:
            above = up[at]
            if (above == at).all():
                up[nodes] = at
                return at
            at = above

    def join_all(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Join one[i] with two[i] for all i; the i that joined two trees.

        Pairs already in one tree are passed over in bulk, so a dense cluster
        costs little more than its spanning tree.
        """
        joined = []
        for low in range(0, len(one), 4096):
            a, b = self.roots(one[low : low + 4096]), self.roots(two[low : low + 4096])
            open_ = np.flatnonzero(a != b)
            up = dict.fromkeys((*a[open_].tolist(), *b[open_].tolist()))
            up = {x: x for x in up}

            def find(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for i, x, y in zip(open_.tolist(), a[open_].tolist(), b[open_].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    joined.append(low + i)
            for x in up:
                self.up[x] = find(x)
        return np.array(joined, np.int64)
