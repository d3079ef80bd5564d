"""A data source for file trees that keeps what Spark's own file sources drop.

Hidden and underscored names, empty files, brackets in names and k=v folders all count; a missing folder is empty.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import EXTENSIONS
from .images import measured

SCHEMA = "subset string, path string, length long, sha256 string, content binary"
MEASURED_SCHEMA = SCHEMA.replace("content binary", "w int, h int, grid array<int>, status string")
BACKUP = "backup_removed_"


def walk(folder: str) -> Iterator[tuple[str, str, int]]:
    """(folder, path, length) of every file below; links to folders aren't followed."""
    for at, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(at, name)
            try:
                yield at, path, os.stat(path).st_size
            except OSError:
                yield at, path, 0


def listed(root: str, subset: str, layout: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files of one split. images: only below its images folder; auto: below the split itself if that has none.

    auto skips backups and the files of folders whose own name begins with a dot; folders below those still count.
    """

    def below(folder: str, careful: bool) -> list[tuple[str, int]]:
        return [
            (path, size) for at, path, size in walk(folder)
            if os.path.splitext(path)[1].lower() in suffixes and not (careful and (BACKUP in at or os.path.basename(at).startswith(".")))
        ]

    if layout == "plain":
        return [(root, os.path.getsize(root))] if os.path.isfile(root) and os.path.splitext(root)[1].lower() in suffixes else below(root, False)
    home = os.path.join(root, subset)
    found = below(os.path.join(home, "images"), layout == "auto")
    return found or (below(home, True) if layout == "auto" else [])


@dataclass
class Files(InputPartition):
    items: list[tuple[str, str, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path") or options["root"]
        self.layout = options.get("layout", "images")
        self.subsets = [s for s in options.get("subsets", "").split(",") if s] if self.layout != "plain" else [""]
        self.suffixes = tuple(options.get("suffixes", ",".join(EXTENSIONS)).split(","))
        self.content = options.get("content", "true").lower() == "true"
        self.aside = options.get("measure")
        self.most = int(options.get("partitionbytes", 64 << 20))
        if len(set(self.subsets)) < len(self.subsets):
            raise ValueError("a split is named twice")

    def partitions(self) -> list[Files]:
        """Files in path order, packed to about the same number of bytes."""
        out, held, size = [], [], 0
        for s in self.subsets:
            for path, n in sorted(listed(self.root, s, self.layout, self.suffixes)):
                held.append((s, path, n))
                size += n + 65_536
                if size >= self.most:
                    out.append(Files(held))
                    held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for s, path, n in partition.items:
            digest, data = hashlib.sha256(), None
            try:
                with open(path, "rb") as f:
                    if self.content or self.aside:
                        data = f.read()
                        digest.update(data)
                    else:
                        while block := f.read(1 << 20):
                            digest.update(block)
                sha = digest.hexdigest()
            except OSError:
                sha = data = None
            yield (s, path, n, sha, *measured(data, sha, self.aside)) if self.aside else (s, path, n, sha, data)


class TreeSource(DataSource):
    """Format file_tree: options root or path, subsets, layout (images, auto, plain), suffixes, content, partitionBytes.

    The option measure names a folder for images that the JVM is to decode; then each file's size, brightness grid and
    status are there in place of its content, which never leaves the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return MEASURED_SCHEMA if self.options.get("measure") else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, subsets: list[str] | None = None, layout: str = "images", suffixes: tuple[str, ...] = EXTENSIONS, content: bool = True, measure: str | None = None) -> DataFrame:
    """(subset, path, length, sha256, content) of a tree; a file that can't be read has a null digest.

    With measure, a folder, it has w, h, grid and status in place of content.
    """
    spark.dataSource.register(TreeSource)
    r = spark.read.format("file_tree").option("root", root).option("layout", layout).option("suffixes", ",".join(suffixes)).option("content", str(content).lower())
    r = r.option("measure", measure) if measure else r
    return r.option("subsets", ",".join(subsets or [])).load()


def read_labels(spark: SparkSession, root: str, subsets: list[str]) -> DataFrame:
    """(subset, path, content) of every label file of the splits; an empty file is there with empty content."""
    parts = [read_tree(spark, os.path.join(root, s), layout="plain", suffixes=(".txt",)).select(F.lit(s).alias("subset"), "path", "content") for s in subsets]
    return reduce(DataFrame.unionByName, parts)
