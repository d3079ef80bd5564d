"""Connected components: of edges in one place, and of edges without a bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in any edge, and the smallest value each is connected with."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:  # hook the larger root to the smaller, then flatten, until all edges agree
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (lo == hi).all():
            return values, values[root]
        np.minimum.at(root, hi, lo)
        while not np.array_equal(root, root[root]):
            root = root[root]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group): every vertex of the edges (a < b, of any type that has an order) with the smallest of its component.

    Large-star and small-star rounds until nothing changes; each round's edges are written to the shared folder.
    """
    e = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is linked to the smallest of u and its neighbours
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(near, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour and u itself are linked to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
