"""Bounding boxes: lenient parsing, clamping and formatting of label lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import once

#: A line of a label file: a class and four plain numbers.
LINE = r"^\s*(\d+)" + r"\s+([0-9]*\.?[0-9]+)" * 4 + r"\s*$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOX = "struct<class_id:string,center_x:string,center_y:string,width:string,height:string,cx:string,cy:string,w:string,h:string>"


def clamp(x: Column) -> Column:
    """Into [0, 1]; NaN becomes 1, null stays."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def number(text: Column) -> Column:
    """A plain decimal number as a double, null for anything else."""
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))


def line_class(line: Column) -> Column:
    """The class that a label line begins with, truncated to a whole number; null if it is none."""
    return number(F.get(F.split(F.trim(line), r"\s+"), F.lit(0))).try_cast("bigint")


def main_class(lines: Column) -> Column:
    """The most frequent class of an array of label lines, of equals the first to appear; -1 without any."""
    classes = F.filter(F.transform(lines, line_class), lambda c: c.isNotNull())
    distinct = F.array_distinct(classes)
    counted = F.transform(distinct, lambda c, i: F.struct(F.size(F.filter(classes, lambda x: x == c)).alias("n"), (-i).alias("first"), c.alias("c")))
    return F.coalesce(F.array_max(counted)["c"], F.lit(-1).cast("bigint"))


@F.pandas_udf(T.StringType())
def six(x: pd.Series) -> pd.Series:
    """Six decimals, halves as the binary value has it."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.6f}")


def millionths(x: Column) -> Column:
    """Round x of [0, 1] to whole millionths by its binary value, exact halves to even.

    Only what lies close to a half needs care: there the value's bits, as three whole numbers, are multiplied by 10^7
    without rounding, which gives the seventh digit and whether anything follows it.
    """

    def careful(v: Column) -> Column:
        long = lambda c: F.floor(c).cast("long")
        top = F.struct(long(v * 2.0**30).alias("a"), (v * 2.0**30 - F.floor(v * 2.0**30)).alias("r"))
        mid = once(top, lambda t: F.struct(t["a"].alias("a"), long(t["r"] * 2.0**22).alias("b"), (t["r"] * 2.0**22 - F.floor(t["r"] * 2.0**22)).alias("r")))
        low = once(mid, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), (long(t["r"] * 2.0**22) * 10_000_000).alias("c")))
        carry = once(low, lambda t: F.struct(t["a"].alias("a"), (t["b"] * 10_000_000 + F.shiftright(t["c"], 22)).alias("b"), (t["c"] % (1 << 22)).alias("c")))
        whole = once(carry, lambda t: F.struct((t["a"] * 10_000_000 + F.shiftright(t["b"], 22)).alias("n"), ((t["b"] % (1 << 22)) + t["c"]).alias("rest")))
        parts = once(whole, lambda t: F.struct(F.shiftright(t["n"], 30).alias("i"), ((t["n"] % (1 << 30)) + t["rest"]).alias("rest")))

        def settled(t: Column) -> Column:
            half, digit = F.floor(t["i"] / 10).cast("long"), t["i"] % 10
            up = (digit > 5) | ((digit == 5) & ((t["rest"] > 0) | (half % 2 == 1)))
            return half + F.when(up, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

        return once(parts, settled)

    near_half = lambda y: F.abs(y - F.floor(y) - 0.5) < 1e-6
    return once(x, lambda v: F.when(near_half(v * 1e6), careful(v)).otherwise(F.rint(v * 1e6).cast("long")))


def decimals(x: Column) -> Column:
    """x of [0, 1] with six decimals, as its binary value has it."""
    return once(F.lpad(millionths(x).cast("string"), 7, "0"), lambda s: F.concat(F.substring(s, 1, 1), F.lit("."), F.substring(s, 2, 6)))


def formatted(kind: Column, coords: Column) -> Column:
    """A label line of a class and an array of coordinates, which are clamped."""
    return F.concat(kind, F.lit(" "), F.array_join(F.transform(coords, lambda x: decimals(clamp(x))), " "))


def box_lines(boxes: Column, classes: int | None) -> Column:
    """Label lines of typed boxes (class_id, cx, cy, w, h): clamped, without unknown classes and empty boxes.

    A class is cut to a whole number; boxes with a null anywhere give no line, NaN counts as 1, null boxes give null.
    """
    kind = lambda b: b["class_id"].try_cast("long")
    inside = lambda b: (kind(b) >= 0) & (kind(b) < classes) if classes is not None else F.lit(True)
    whole = lambda b: kind(b).isNotNull() & b["cx"].isNotNull() & b["cy"].isNotNull()
    good = F.filter(boxes, lambda b: F.coalesce(whole(b) & inside(b) & (b["w"] > 0) & (b["h"] > 0), F.lit(False)))
    return F.transform(good, lambda b: formatted(kind(b).cast("string"), F.array(*(b[n].cast("double") for n in ("cx", "cy", "w", "h")))))


def text_lines(text: Column) -> Column:
    """Label lines found in free text, clamped and formatted; neither classes nor sizes are checked.

    Digits and blanks are those of ASCII, and a class may have any number of digits.
    """
    rows = F.filter(F.split(text, r"\R"), lambda x: x.rlike(LINE))
    tokens = F.transform(rows, lambda x: F.filter(F.split(x, r"\s+"), lambda t: t != ""))
    return F.transform(tokens, lambda t: formatted(F.regexp_replace(t[0], "^0+(?=.)", ""), F.transform(F.slice(t, 2, 4), lambda v: v.cast("double"))))


def parsed_boxes(reply: Column) -> Column:
    """The boxes of a JSON reply with every value as text; empty unless it is an object with a list of that name.

    What isn't an object in the list is left out, whatever the others are.
    """
    items = F.filter(F.from_json(reply, "boxes array<string>")["boxes"], lambda x: F.ltrim(x).startswith("{") & F.from_json(x, "map<string,string>").isNotNull())
    return F.coalesce(F.transform(items, lambda x: F.from_json(x, BOX)), F.from_json(F.lit("[]"), f"array<{BOX}>"))


def lenient_line(box: object, classes: int | None) -> str | None:
    """One box of any JSON as a label line, or None: numbers may be text, classes are truncated, aliases are taken."""
    if not isinstance(box, dict):
        return None
    try:
        kind = int(box["class_id"])
        values = [float(box[name] if name in box else box[alias]) for name, alias in (("center_x", "cx"), ("center_y", "cy"), ("width", "w"), ("height", "h"))]
    except (KeyError, TypeError, ValueError, OverflowError):
        return None
    if classes is not None and not 0 <= kind < classes:
        return None
    # the order of min's arguments makes NaN the upper end
    values = [max(0.0, min(1.0, v)) for v in values]
    return " ".join([str(kind), *(f"{v:.6f}" for v in values)]) if values[2] > 0 and values[3] > 0 else None


def reply_boxes(reply: str | None) -> list:
    """The list of boxes in a model's JSON reply; empty for anything else."""
    try:
        got = json.loads(reply or "")
    except ValueError:
        return []
    boxes = got.get("boxes") if isinstance(got, dict) else None
    return boxes if isinstance(boxes, list) else []


def reply_lines(reply: str | None, classes: int | None) -> list[str]:
    return [x for b in reply_boxes(reply) if (x := lenient_line(b, classes)) is not None]


def json_lines(reply: Column, classes: int | None) -> Column:
    """reply_lines() of a column, in Arrow batches: the lenient form for any JSON, box by box; null gives no lines."""
    return F.pandas_udf(lambda replies: replies.map(lambda r: reply_lines(r, classes)), T.ArrayType(T.StringType()))(reply)


_LINE = re.compile(LINE)


def free_lines(text: str | None) -> list[str]:
    """text_lines() for one text, with exact decimals."""
    out = []
    for row in (text or "").splitlines():
        if m := _LINE.match(row):
            out.append(" ".join([str(int(m[1])), *(f"{max(0.0, min(1.0, float(x))):.6f}" for x in m.groups()[1:])]))
    return out
