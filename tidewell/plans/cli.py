"""Commands: cleanup, label, config and frames. Try python -m tidewell.plans.cli COMMAND --help."""

from __future__ import annotations

import argparse
import functools
import json
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.paths import flat_label_path
from ..operators import annotate as model
from ..sources import config as cfg
from ..sources.files import read_tree
from ..sources.images import with_size
from ..sources.scratch import release, settle
from ..sources.video import frames, write_frames
from . import cleanup

log = logging.getLogger("tidewell")


def session() -> SparkSession:
    return SparkSession.builder.appName("tidewell").config("spark.speculation", "false").getOrCreate()


def run_cleanup(a: argparse.Namespace) -> int:
    spark = session()
    targets = {s: t for s, t in (("train", a.train_target), ("valid", a.valid_target)) if t is not None}
    p = cleanup.plan(cleanup.scan(spark, a.root, a.subsets).persist(), a.subsets, targets, a.dhash_threshold, a.seed, a.cross_split_dedup)
    print(json.dumps(p.summary(), indent=2))
    if a.output_json:
        os.makedirs(a.output_json, exist_ok=True)
        cleanup.write_plan(p, a.output_json)
    if a.apply:
        backup = a.backup_dir or cleanup.default_backup(a.root)
        os.makedirs(backup, exist_ok=True)
        cleanup.write_plan(p, backup)  # before anything moves, and read from there
        planned = spark.read.schema("subset string, image string, label string").json(os.path.join(backup, "removals"))
        done = cleanup.apply(planned, a.root, backup).groupBy("image_status", "label_status").count().collect()
        for r in done:
            bad = {r.image_status, r.label_status} - {"moved", "none", "missing"}
            log.log(logging.WARNING if bad else logging.INFO, "%d: image %s, label %s", r["count"], r.image_status, r.label_status)
    return 0


def run_label(a: argparse.Namespace) -> int:
    if a.provider not in model.PROVIDERS:
        print(f"no provider is registered as {a.provider}", file=sys.stderr)
        return 1
    if (secret := model.SECRETS.get(a.provider)) and not os.environ.get(secret):
        print(f"{secret} isn't set", file=sys.stderr)
        return 1
    try:
        config = cfg.load_config(a.config)
    except (cfg.ConfigMissing, cfg.ConfigInvalid) as e:
        print(e, file=sys.stderr)
        return 3 if isinstance(e, cfg.ConfigMissing) else 4
    spark = session()
    images = with_size(read_tree(spark, a.images, layout="plain")).select("path", "w", "h", "content")
    images = images.withColumn("label_path", flat_label_path(F.col("path"), F.lit(a.out_dir) if a.out_dir else None))
    if not read_tree(spark, a.images, layout="plain", content=False).limit(1).count():
        print("no images", file=sys.stderr)
        return 2
    there = read_tree(spark, a.out_dir or (a.images if os.path.isdir(a.images) else os.path.dirname(a.images)), layout="plain", suffixes=(".txt",), content=False)
    todo = model.pending(images, there, a.overwrite)
    factory = model.PROVIDERS[a.provider]
    got = model.annotate(todo, functools.partial(factory, a.model) if a.model else factory, config["classes"], config.get("prompt_notes", ""), a.strict_fallback, a.requests)
    got = settle(got.withColumn("label_path", flat_label_path(F.col("path"), F.lit(a.out_dir) if a.out_dir else None)))  # asked once
    model.write_labels(got)
    if a.save_raw:
        got.select("path", "raw").write.mode("overwrite").json(a.save_raw)
    for r in got.where("error is not null").select("path", "error").toLocalIterator():
        print(f"{r.path}: {r.error}", file=sys.stderr)
    n = got.agg(F.count_if(F.col("error").isNull()).alias("files"), F.sum(F.when(F.col("error").isNull(), F.col("n"))).alias("boxes"), F.count_if("used_fallback").alias("again"), F.count("error").alias("failed")).first()
    log.info("wrote %d label files with %d boxes, %d by the fallback; %d images failed", n.files, n.boxes or 0, n.again, n.failed)
    return 0


def run_config(a: argparse.Namespace) -> int:
    made = cfg.interview() if a.classes is None else cfg.make_config(cfg.parse_classes(a.classes), None, a.notes)
    try:
        cfg.save_config(made, a.out)
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def run_frames(a: argparse.Namespace) -> int:
    spark = session()
    if not os.path.isfile(a.video):
        print(f"no video at {a.video}", file=sys.stderr)
        return 2
    found = settle(frames(read_tree(spark, a.video, layout="plain", suffixes=(os.path.splitext(a.video)[1].lower(),)), strict=True))
    write_frames(found, a.out)
    log.info("wrote %d frames to %s", found.count(), a.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("cleanup", help="plan removals, and carry them out with --apply")
    c.add_argument("--root", required=True)
    c.add_argument("--subsets", nargs="+", default=["train", "valid"])
    for s in ("train", "valid"):
        c.add_argument(f"--{s}-target", type=int)
    c.add_argument("--dhash-threshold", type=int, default=5)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--cross-split-dedup", action="store_true")
    c.add_argument("--apply", action="store_true")
    c.add_argument("--backup-dir")
    c.add_argument("--output-json", help="a folder for the plan")
    c.set_defaults(run=run_cleanup)
    c = sub.add_parser("label", help="label images by a registered provider")
    c.add_argument("--images", required=True)
    c.add_argument("--out-dir")
    c.add_argument("--provider", required=True)
    c.add_argument("--model", help="handed to the provider, which has its own by default")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--save-raw")
    c.add_argument("--strict-fallback", action="store_true")
    c.add_argument("--requests", type=int)
    c.add_argument("--config", default="labeling_config.json")
    c.set_defaults(run=run_label)
    c = sub.add_parser("config", help="make the labelling configuration")
    c.add_argument("--classes")
    c.add_argument("--notes")
    c.add_argument("--out", default="labeling_config.json")
    c.set_defaults(run=run_config)
    c = sub.add_parser("frames", help="write a video's frames as JPEG")
    c.add_argument("--video", required=True)
    c.add_argument("--out", required=True)
    c.set_defaults(run=run_frames)
    return p


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    finally:
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


if __name__ == "__main__":
    sys.exit(main())
