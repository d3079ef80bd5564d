"""Digests and 64-bit difference hashes as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def difference_bits(cells: Column, width: int = 9) -> Column:
    """64 bits of an 8-row grid: a bit is set where a cell exceeds its right neighbour, the first cell's bit on top."""
    per = width - 1

    def bits(grid: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = F.floor(i / per).cast("int") * width + i % per
            return F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(grid, at) > F.get(grid, at + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), step)

    return once(cells, bits)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time, however often a lambda inside looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_bits(values: Column, wrap: bool = False) -> Column:
    """64 bits of a row of values: bit i is set where value i exceeds the next; with wrap the last meets the first."""

    def bits(v: Column) -> Column:
        nxt = F.concat(F.slice(v, 2, 63), F.slice(v, 1, 1)) if wrap else F.slice(v, 2, 64)
        more = F.zip_with(F.slice(v, 1, 64), nxt, lambda a, b: F.when(a > b, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.aggregate(more, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))

    return once(values, bits)


def vowel_profile(text: Column) -> Column:
    """65 counts of vowels in even slices of a text, the stand-in for an image's row of brightness.

    Slices are cut from four bytes a character, where a place is found at once however long the text.
    """

    def count(wide: Column, n: Column, i: Column) -> Column:
        start, size = F.floor(i * n / 65).cast("int"), F.greatest(F.lit(1), F.floor(n / 65).cast("int"))
        part = F.decode(F.substr(wide, start * 4 + 1, size * 4), "UTF-32")
        return F.length(part) - F.length(F.translate(part, "aeiou", ""))

    return once(F.struct(F.encode(text, "UTF-32").alias("wide"), F.length(text).alias("n")), lambda x: F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: count(x["wide"], x["n"], i)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def prefix(h: Column) -> Column:
    """The top 12 bits, unsigned."""
    return F.shiftrightunsigned(h, 52)


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")
