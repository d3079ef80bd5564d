"""Paths of images, labels, backups and frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; a name of only a leading dot and letters has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.*[^.].*?(\.[^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def label_path(path: Column, root: Column | None = None) -> Column:
    """The label file that belongs to an image: the first `images` folder becomes `labels`, the extension .txt.

    With a root (a split's folder) only folders below it count. Without an `images` folder the result is empty.
    """
    below = path if root is None else F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 1)).otherwise(path)
    parts = F.split(below, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(folders, "images")
    name = F.regexp_replace(F.element_at(parts, -1), r"^(.*[^.].*)\.[^.]*$", "$1")
    swapped = F.transform(folders, lambda x, i: F.when(i + 1 == at, F.lit("labels")).otherwise(x))
    head = F.lit("") if root is None else F.when(F.startswith(path, F.concat(root, F.lit("/"))), root).otherwise("")
    return F.when(at > 0, F.concat(head, F.array_join(F.concat(swapped, F.array(F.concat(name, F.lit(".txt")))), "/"))).otherwise("")


def backup_path(path: Column, split_root: Column, backup: Column, subset: Column) -> Column:
    """Where a removed file goes: the backup mirrors the split, so files of different splits or folders never meet."""
    return F.concat_ws("/", backup, subset, F.substr(path, F.length(split_root) + 2))


def flat_label_path(path: Column, out_dir: Column | None) -> Column:
    """The image's stem with .txt beside it, or directly in out_dir."""
    stem = F.regexp_replace(base_name(path), r"^(.*[^.].*)\.[^.]*$", "$1")
    folder = F.regexp_replace(path, r"/[^/]*$", "") if out_dir is None else out_dir
    return F.concat(folder, F.lit("/"), stem, F.lit(".txt"))


def frame_name(n: Column) -> Column:
    return F.format_string("frame_%05d.jpg", n)
