"""Main classes, class-balanced quotas and the stratified sample that fills them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def main_class(rows: DataFrame, key: str, cls: str, position: str) -> DataFrame:
    """(key, cls): the most frequent class of each key, of equals the one that comes first by position."""
    n = rows.where(F.col(cls).isNotNull()).groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return n.groupBy(key).agg(F.max_by(cls, F.struct("n", -F.col("first"))).alias(cls))


def with_class(images: DataFrame, classes: DataFrame, key: str, cls: str) -> DataFrame:
    """Images with their class, -1 where there is none."""
    return images.join(classes, key, "left").withColumn(cls, F.coalesce(cls, F.lit(-1)))


def quotas(counts: DataFrame, targets: dict[str, int | None]) -> DataFrame:
    """(subset, cls, n, quota) from counts (subset, cls, n): each class's share of its split's target, repaired to add up.

    Shares are rounded half to even. What is missing is given one each to the classes with most room, what is too much
    taken one each from those with least; equals go by class. A split without a target, or no larger, keeps all.
    """
    if any(t is not None and t < 0 for t in targets.values()):
        raise ValueError("a target must not be negative")
    target = F.coalesce(*[F.when(F.col("subset") == s, F.lit(t)) for s, t in targets.items() if t is not None], F.lit(None).cast("int")).cast("long")
    split = Window.partitionBy("subset")
    c = counts.withColumn("total", F.sum("n").over(split)).withColumn("target", target)
    all_kept = F.col("target").isNull() | (F.col("total") <= F.col("target"))
    c = c.withColumn("q", F.when(all_kept, F.col("n")).otherwise(F.rint(F.col("target") * (F.col("n") / F.col("total"))).cast("long")))
    c = c.withColumn("diff", F.when(all_kept, F.lit(0)).otherwise(F.col("target") - F.sum("q").over(split)))
    room = F.col("n") - F.col("q")
    open_ = F.when(F.col("diff") > 0, room > 0).otherwise(F.col("q") > 0)
    rank = F.row_number().over(Window.partitionBy("subset", open_).orderBy(F.when(F.col("diff") > 0, -room).otherwise(room), "cls"))
    c = c.withColumn("quota", F.col("q") + F.when(open_ & (rank <= F.abs("diff")), F.sign("diff").cast("long")).otherwise(0))
    return c.select("subset", "cls", "n", F.col("quota").cast("long").alias("quota"))


def draw(key: Column, seed: int) -> Column:
    """A reproducible random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def sample(images: DataFrame, quota: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """The images (subset, cls, key, ...) with `kept`: whether the key is among its class's quota in a random order.

    A null split or class is one like any other, a null key is drawn first. Rows of a class without a quota are all kept.
    Draws are counted by their first digits, so only draws that begin alike are ever sorted together, however large the class.
    """
    drawn = images.withColumn("__draw", F.coalesce(draw(F.col(key).cast("string"), seed), F.lit(""))).withColumn("__bin", F.substring("__draw", 1, 4))
    bins = drawn.groupBy(F.col("subset").alias("__s"), F.col("cls").alias("__c"), F.col("__bin").alias("__b")).agg(F.count(F.lit(1)).alias("__here"))
    run = Window.partitionBy("__s", "__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("__before", F.sum("__here").over(run) - F.col("__here"))
    q = quota.select(F.col("subset").alias("__qs"), F.col("cls").alias("__qc"), F.col("quota").alias("__quota"))
    bins = bins.join(q, F.col("__s").eqNullSafe(F.col("__qs")) & F.col("__c").eqNullSafe(F.col("__qc")), "left")
    rank = F.row_number().over(Window.partitionBy("subset", "cls", "__bin").orderBy("__draw", key))
    here = F.col("subset").eqNullSafe(F.col("__s")) & F.col("cls").eqNullSafe(F.col("__c")) & (F.col("__bin") == F.col("__b"))
    ranked = drawn.withColumn("__rank", rank).join(bins, here)
    kept = F.col("__quota").isNull() | (F.col("__before") + F.col("__rank") <= F.col("__quota"))
    return ranked.withColumn("kept", kept).select(*images.columns, "kept")
