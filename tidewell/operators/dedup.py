"""Exact duplicates, near-duplicate clusters and which member of each stays.

An images table has subset, image (a unique path), label, sha256, dhash (64 bits, null counts as 0) and res. A scope is a
split, or "*" for all splits together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming, prefix
from ..sources.scratch import settle
from .graph import components, union_find

THRESHOLD = 5
#: Edges of one prefix that a task settles by itself; beyond them they are settled in rounds over all executors.
ALONE = 1_000_000


def scoped(images: DataFrame, across: bool) -> DataFrame:
    return images.withColumns({"scope": F.lit("*") if across else F.col("subset"), "dhash": F.coalesce("dhash", F.lit(0).cast("long"))})


def order() -> Column:
    """What stays comes first: validation images, then more pixels, then the path."""
    return F.struct(F.when(F.col("subset") == "valid", 0).otherwise(1).alias("v"), (-F.coalesce("res", F.lit(0).cast("long"))).alias("r"), F.col("image").alias("image"))


def exact_groups(images: DataFrame, across: bool = False) -> DataFrame:
    """(scope, sha256, n, keep) for every digest that occurs more than once in a scope; null digests never group."""
    s = scoped(images, across).where(F.col("sha256").isNotNull())
    g = s.groupBy("scope", "sha256").agg(F.count(F.lit(1)).alias("n"), F.min(order()).alias("best"))
    return g.where("n > 1").select("scope", "sha256", "n", F.col("best.image").alias("keep"))


def exact_removed(images: DataFrame, across: bool = False) -> DataFrame:
    """The rows of images, with scope and keep, that have a better copy in their scope."""
    g = exact_groups(images, across).select("scope", "sha256", "keep")
    return scoped(images, across).join(g, ["scope", "sha256"]).where(F.col("image") != F.col("keep"))


def hashes(images: DataFrame, across: bool = False) -> DataFrame:
    """(scope, dhash, n, best): each different hash of a scope once; the rest works on these alone."""
    return scoped(images, across).groupBy("scope", "dhash").agg(F.count(F.lit(1)).alias("n"), F.min(order()).alias("best"))


def near_pairs(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(scope, a, b, distance) with a before b: different hashes of one prefix within the threshold.

    The 52 bits below the prefix are cut into threshold + 1 pieces; hashes that near agree in one at least, so they meet by
    an equality join on scope, prefix and piece. That finds every pair and no bucket is compared as a whole.
    """
    if not 0 <= threshold <= 64:
        raise ValueError("the threshold must lie between 0 and 64")
    pieces = min(threshold + 1, 52)
    edges = [round(i * 52 / pieces) for i in range(pieces + 1)]
    cut = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("dhash", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    if threshold >= 52:
        cut = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("v")))
    keyed = distinct.select("scope", "dhash", prefix(F.col("dhash")).alias("p"), F.explode(cut).alias("c")).select("scope", "dhash", "p", F.col("c.i").alias("i"), F.col("c.v").alias("v"))
    a, b = keyed.withColumnRenamed("dhash", "a"), keyed.withColumnRenamed("dhash", "b")
    met = a.join(b, ["scope", "p", "i", "v"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= threshold))
    return met.select("scope", "a", "b", hamming(F.col("a"), F.col("b")).alias("distance")).distinct()


def _components(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    values, root = union_find(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
    return pd.DataFrame({"scope": key[0], "dhash": values, "cluster": root})


def clusters(images: DataFrame, threshold: int = THRESHOLD, across: bool = False, alone: int = ALONE) -> DataFrame:
    """(scope, dhash, cluster, size, keep) for every hash whose cluster has more than one image.

    Clusters are connected within scope and prefix; edges never leave a prefix, so each is settled by itself, one of more
    than `alone` edges by all executors together.
    """
    h = hashes(images, across)
    edges = settle(near_pairs(h.select("scope", "dhash"), threshold).withColumn("p", prefix(F.col("a"))))
    crowd = edges.groupBy("scope", "p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alone).select("scope", "p")
    few = edges.join(crowd, ["scope", "p"], "left_anti")
    linked = few.groupBy("scope", "p").applyInPandas(_components, "scope string, dhash long, cluster long")
    if crowd.limit(1).count():
        many = edges.join(crowd, ["scope", "p"], "left_semi")
        at = components(many.select(F.struct("scope", F.col("a").alias("h")).alias("a"), F.struct("scope", F.col("b").alias("h")).alias("b")))
        linked = linked.unionByName(at.select(F.col("id.scope").alias("scope"), F.col("id.h").alias("dhash"), F.col("group.h").alias("cluster")))
    all_h = h.join(linked, ["scope", "dhash"], "left").withColumn("cluster", F.coalesce("cluster", "dhash"))
    g = all_h.groupBy("scope", "cluster").agg(F.sum("n").alias("size"), F.min("best").alias("best")).where("size > 1")
    return all_h.select("scope", "dhash", "cluster").join(g, ["scope", "cluster"]).select("scope", "dhash", "cluster", "size", F.col("best.image").alias("keep"))


def near_members(images: DataFrame, threshold: int = THRESHOLD, across: bool = False) -> DataFrame:
    """The rows of images in near-duplicate clusters, with scope, cluster, size and keep."""
    return scoped(images, across).join(clusters(images, threshold, across), ["scope", "dhash"])


def deduplicate(images: DataFrame, threshold: int = THRESHOLD, across: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact, near, remaining): removed as exact copies, removed from near clusters of the survivors, and what is left."""
    exact = exact_removed(images, across)
    rest = images.join(exact.select("image"), "image", "left_anti")
    members = near_members(rest, threshold, across)
    near = members.where(F.col("image") != F.col("keep"))
    return exact, near, rest.join(near.select("image"), "image", "left_anti")
