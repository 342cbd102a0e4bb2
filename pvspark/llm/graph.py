"""Connected components, whole and inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.shared import stored


class Groups:
    """Union-find over any keys, for one task. The smallest key of a group is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, x, y) -> bool:
        """Whether x and y were in different groups."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self, keys: list) -> np.ndarray:
        return np.array([self.root(k) for k in keys], np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in `edges` (a, b): root is the smallest id that can be reached. Links of an id to itself and nulls don't count.

    Alternating stars: each id hangs its larger, then its smaller neighbours on the smallest one, until nothing changes. Edges
    stay distributed and never outgrow the input; minima are partial before the shuffle, and the joins that follow meet one row
    per id, so adaptive execution can split an id with very many neighbours.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.filter("a <> b").select(a, b).distinct(), "edges")
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).alias("mark")
    before = edges.select(mark).first()[0]
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "edges")
        now = edges.select(mark).first()[0]
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
