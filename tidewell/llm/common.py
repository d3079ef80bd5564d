"""Helpers that the text operators share: packed rows, written scratch tables and columnar words."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import settle  # noqa: F401 (the operators take it from here)

#: What separates words: any run of characters that are neither letters nor digits.
GAP = r"[^\p{L}\p{N}]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; what the session sets itself stays."""
    for key, usual, ours in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647", "33554432"),
    ):
        try:
            if spark.conf.get(key, usual) == usual:
                spark.conf.set(key, ours)
        except Exception as e:  # a Spark without the key, or with another type for it
            if "CANNOT_MODIFY" in str(e):
                raise


def lean() -> None:
    """Give back memory that a worker's earlier tasks freed but still hold, as far as the system lets it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as one array of strings with 64-bit offsets."""
    a = batch.column(batch.schema.get_field_index(name))
    return a if pa.types.is_large_string(a.type) else a.cast(pa.large_string())


def word_lists(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts in one array, and where each text's words begin and end; null has none."""
    low = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), GAP, " "), " ")
    lists = pc.split_pattern(low, " ")
    flat, off = lists.values, np.asarray(lists.offsets).astype(np.int64)
    flat = flat.slice(off[0], off[-1] - off[0])
    off = off - off[0]
    empty = np.asarray(pc.equal(low, ""))  # an empty text has one empty word
    if empty.any():
        flat = flat.filter(pc.not_equal(flat, ""))
        off = off - np.concatenate([[0], np.cumsum(empty)])
    return flat, off


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Words as codes into the list of distinct words."""
    d = flat.dictionary_encode()
    return np.asarray(d.indices), d.dictionary.to_pylist()


def digests(words: list[str], cache: dict[str, bytes], most: int = 400_000) -> np.ndarray:
    """16 bytes of MD5 for each word; the cache is emptied when it holds too much."""
    if len(cache) > most:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = hashlib.md5(w.encode(), usedforsecurity=False).digest()
        out.append(h)
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 16)


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `most` bytes of text in one column; a longer text stands alone."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(name))), 0)).astype(np.int64)
        at = 0
        total = np.cumsum(size)
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end
