"""Prompts for an annotator, as column expressions and for one image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TASK = "Act as a careful annotator who draws object detection boxes. The classes that count are: "
RULES = (
    ".\n\nHow to work:\n- Leave out whatever is not in the list.\n- Fit each box to what can be seen of the object.\n"
    "- Give coordinates as fractions of width and height.\n- With nothing to annotate, give an empty list.\n\n"
    "Reply with one JSON object that has the key 'boxes' and no other text."
)
NOTES, SIZE = "\n\nFurther notes:\n", "\n\nThe picture has width="
SCHEMA = '.\nWrite each box as {"class_id": int, "center_x": float, "center_y": float, "width": float, "height": float}, all four fractions within [0,1].'
PLAIN = "\n\nReply with label lines alone, one object a line: class_id center_x center_y width height."


def class_list(classes: Column) -> Column:
    """Numbered names of an array of (name, description), descriptions in brackets, with commas."""
    return F.array_join(
        F.transform(classes, lambda c, i: F.concat(i.cast("string"), F.lit(" "), F.coalesce(c["name"], F.lit("class")), F.when(F.coalesce(c["description"], F.lit("")) != "", F.concat(F.lit(" ("), c["description"], F.lit(")"))).otherwise(""))),
        ", ",
    )


def prompt(width: Column, height: Column, classes: Column, notes: Column) -> Column:
    noted = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit(NOTES), notes)).otherwise("")
    return F.concat(F.lit(TASK), class_list(classes), F.lit(RULES), noted, F.lit(SIZE), width.cast("string"), F.lit(" height="), height.cast("string"), F.lit(SCHEMA))


def prompt_text(width: int, height: int, classes: list[dict], notes: str = "") -> str:
    names = ", ".join(f"{i} {c.get('name', 'class')}" + (f" ({c['description']})" if c.get("description") else "") for i, c in enumerate(classes))
    return f"{TASK}{names}{RULES}{NOTES + notes if notes else ''}{SIZE}{width} height={height}{SCHEMA}"
