"""The cleanup plan of an image tree: what to remove and why, and moving it to a backup without loss."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import main_class
from ..functions.paths import label_path
from ..operators import dedup, sampling
from ..sources.files import read_labels, read_tree
from ..sources.images import made_aside, with_metadata
from ..sources.scratch import settle


@dataclass
class Plan:
    """images: the whole table; exact, near and sampled: rows to remove, disjoint; quota: the classes' shares."""

    images: DataFrame
    subsets: list[str]
    targets: dict[str, int | None]
    exact: DataFrame
    near: DataFrame
    sampled: DataFrame
    quota: DataFrame
    groups: DataFrame
    clusters: DataFrame

    def removals(self) -> DataFrame:
        """(subset, image, label, reason) of everything to remove."""
        parts = [d.select("subset", "image", F.coalesce("label", F.lit("")).alias("label"), F.lit(r).alias("reason")) for d, r in ((self.exact, "exact"), (self.near, "near"), (self.sampled, "downsample"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def counts(self) -> DataFrame:
        """(subset, initial, exact, near, sampled, after_dedup, final) of every named split, empty ones too."""
        spark = self.images.sparkSession
        names = spark.createDataFrame([(s, i) for i, s in enumerate(self.subsets)], "subset string, subset_ord int")
        initial = self.images.groupBy("subset").agg(F.count(F.lit(1)).alias("initial"))
        gone = self.removals().groupBy("subset").agg(*[F.count_if(F.col("reason") == r).alias(n) for r, n in (("exact", "exact"), ("near", "near"), ("downsample", "sampled"))])
        c = names.join(initial, "subset", "left").join(gone, "subset", "left").fillna(0)
        c = c.withColumn("after_dedup", F.col("initial") - F.col("exact") - F.col("near"))
        return c.withColumn("final", F.col("after_dedup") - F.col("sampled"))

    def summary(self) -> dict:
        """Counts by split and in all, as the plan's file has them."""
        rows = sorted(self.counts().collect(), key=lambda r: r.subset_ord)
        by = lambda name: {r.subset: r[name] for r in rows}
        return {
            "initial_counts": by("initial"),
            "after_dedup_counts": by("after_dedup"),
            "targets": self.targets,
            "planned_final_counts": by("final"),
            "exact_duplicates_groups": self.groups.count(),
            "exact_removed": sum(r.exact for r in rows),
            "near_duplicates_clusters": self.clusters.count(),
            "near_removed": sum(r.near for r in rows),
            "sampling_details": {r.subset: {"kept": r.final, "removed": r.sampled} for r in rows},
        }


def plan(images: DataFrame, subsets: list[str], targets: dict[str, int | None] | None = None, threshold: int = dedup.THRESHOLD, seed: int = sampling.SEED, across: bool = False) -> Plan:
    """A plan for images (subset, image, label, sha256, dhash, res, cls, and key, by which samples are drawn).

    Exact copies go first, then near-duplicates of what is left, then what exceeds the targets.
    """
    if len(set(subsets)) < len(subsets):
        raise ValueError("a split is named twice")
    targets = targets or {}
    name = ["subset", "image", "label"]
    # each kind of removal is written once: the counts and the moves read those small tables
    exact = settle(dedup.exact_removed(images, across).select(*name, "scope", "keep"))
    unique = images.join(exact.select("image"), "image", "left_anti")
    near = settle(dedup.near_members(unique, threshold, across).where(F.col("image") != F.col("keep")).select(*name, "scope", "keep"))
    rest = unique.join(near.select("image"), "image", "left_anti")
    quota = sampling.quotas(rest.groupBy("subset", "cls").agg(F.count(F.lit(1)).alias("n")), targets)
    sampled = settle(sampling.sample(rest, quota, "key", seed).where(~F.col("kept")).select(*name))
    return Plan(images, subsets, targets, exact, near, sampled, quota, exact.select("scope", "keep").distinct(), near.select("scope", "keep").distinct())


def scan(spark: SparkSession, root: str, subsets: list[str], layout: str = "auto", undecodable: str = "cluster") -> DataFrame:
    """The images table of a tree, with metadata and main classes from the label files."""
    aside = made_aside(spark)
    files = with_metadata(read_tree(spark, root, subsets, layout, content=False, measure=aside), undecodable, aside)
    home = F.concat(F.lit(root.rstrip("/") + "/"), F.col("subset"))
    images = files.withColumnRenamed("path", "image").withColumn("label", label_path(F.col("image"), home))
    lines = read_labels(spark, root, subsets).select(F.col("path").alias("label"), main_class(F.split(F.col("content").cast("string"), r"\R")).alias("cls"))
    found = images.join(lines, "label", "left").withColumn("cls", F.coalesce("cls", F.lit(-1).cast("long")))
    return found.withColumn("key", F.substr(F.col("image"), F.lit(len(root.rstrip("/")) + 2)))


def write_plan(p: Plan, path: str) -> dict:
    """The removals as JSON lines under path, split into a folder for each reason, and the summary beside them.

    Rows are in the order of the named splits, then of the paths, over the part files in their order.
    """
    place = F.array_position(F.lit(p.subsets), F.col("subset"))
    p.removals().orderBy("reason", place, "image").write.mode("overwrite").partitionBy("reason").json(os.path.join(path, "removals"))
    s = p.summary()
    with open(os.path.join(path, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(s, f, indent=2)
    return s


def default_backup(root: str) -> str:
    return os.path.join(root, datetime.datetime.now().strftime("backup_removed_%Y%m%d_%H%M%S"))


def _same(a: str, b: str) -> bool:
    def digest(path: str) -> bytes:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.digest()

    return os.path.getsize(a) == os.path.getsize(b) and digest(a) == digest(b)


def move(source: str, target: str) -> str:
    """Copy, compare, then delete; never over another file. Doing it again after a failure ends the same way."""
    if not os.path.isfile(source):
        return "moved" if os.path.isfile(target) else "missing"
    if os.path.exists(target) and not _same(source, target):
        return "conflict"
    if not os.path.exists(target):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{os.getpid()}.part"
        shutil.copy2(source, part)
        if not _same(source, part):
            os.remove(part)
            return "differs"
        os.replace(part, target)
    os.remove(source)
    return "moved"


def apply(removals: DataFrame, root: str, backup: str) -> DataFrame:
    """(subset, image, image_status, label_status) of moving every removal and its label, mirrored by split and folder.

    The moves happen when the result is computed; it is safe to compute it again.
    """
    root = root.rstrip("/")

    def run(batches):
        for b in batches:
            states = []
            for subset, image, label in zip(b["subset"], b["image"], b["label"], strict=True):
                one = []
                for path in (image, label):
                    if not path:
                        one.append("none")
                        continue
                    try:
                        one.append(move(path, os.path.join(backup, subset, os.path.relpath(path, os.path.join(root, subset)))))
                    except OSError as e:
                        one.append(f"failed: {e}")
                states.append(one)
            b = b[["subset", "image"]].copy()
            b["image_status"], b["label_status"] = [s[0] for s in states], [s[1] for s in states]
            yield b

    return removals.select("subset", "image", "label").mapInPandas(run, "subset string, image string, image_status string, label_status string")
