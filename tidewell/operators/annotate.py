"""Annotation by a model: requests, the fallback for empty replies, and label files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import free_lines, reply_lines
from ..functions.prompts import PLAIN, prompt_text


class Annotator(Protocol):
    """Asks a model about one image; structured asks for JSON boxes, otherwise for plain lines."""

    def ask(self, prompt: str, content: bytes, structured: bool) -> str: ...


#: Adapters by name: functions that open a client, called once for each partition, with the model's name if one is asked for.
PROVIDERS: dict[str, Callable[..., Annotator]] = {}
#: Environment variables that hold adapters' keys.
SECRETS: dict[str, str] = {}


def register(name: str, factory: Callable[..., Annotator], secret: str | None = None) -> None:
    """secret names the environment variable, on all executors, that the adapter takes its key from."""
    PROVIDERS[name] = factory
    SECRETS.pop(name, None)
    if secret:
        SECRETS[name] = secret


def pending(images: DataFrame, labels: DataFrame, overwrite: bool = False) -> DataFrame:
    """Images (label_path, ...) whose label file isn't among labels (path) yet, or all of them."""
    return images if overwrite else images.join(labels.select(F.col("path").alias("label_path")), "label_path", "left_anti")


def annotate(images: DataFrame, factory: Callable[[], Annotator], classes: list[dict], notes: str = "", strict_fallback: bool = False, requests: int | None = None) -> DataFrame:
    """(path, lines, n, raw, used_fallback, error) of images (path, content, w, h).

    A reply without usable boxes is asked again for plain lines, which are only held against the class list if
    strict_fallback. One image's failure is its error and nobody else's. `requests` is how many go on at once. Replies
    differ from call to call, so write the result before deriving anything from it.
    """
    n = len(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            rows = []
            for path, content, w, h in zip(b["path"], b["content"], b["w"], b["h"], strict=True):
                raw, again, lines, error = None, False, [], None
                try:
                    if not w or not h:
                        raise ValueError("no image that can be read")
                    text = prompt_text(int(w), int(h), classes, notes)
                    raw = client.ask(text, content, True)
                    lines = reply_lines(raw, n)
                    if not lines:
                        again = True
                        lines = free_lines(client.ask(text + PLAIN, content, False))
                        if strict_fallback:
                            lines = [x for x in lines if int(x.split()[0]) < n and all(float(v) > 0 for v in x.split()[3:])]
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, lines, len(lines), raw, again, error))
            yield pd.DataFrame(rows, columns=["path", "lines", "n", "raw", "used_fallback", "error"])

    some = images.select("path", "content", "w", "h")
    return (some.repartition(requests) if requests else some).mapInPandas(run, "path string, lines array<string>, n int, raw string, used_fallback boolean, error string")


def collisions(images: DataFrame) -> DataFrame:
    """(label_path, n): label files that several images would write."""
    return images.groupBy("label_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_labels(annotated: DataFrame) -> None:
    """Write lines (label_path, lines) as text files; failed rows (error not null) write nothing, collisions are an error."""
    good = annotated.where("error is null") if "error" in annotated.columns else annotated
    twice = collisions(good).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].n} images would write {twice[0].label_path}")

    def put(rows) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(r.label_path), exist_ok=True)
            part = f"{r.label_path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write("\n".join(r.lines))
            os.replace(part, r.label_path)

    good.select("label_path", "lines").foreachPartition(put)
