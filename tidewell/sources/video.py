"""Videos to frames."""

from __future__ import annotations

import importlib.util
import logging
import os
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import frame_name
from .scratch import run_dir


def jpeg_frames(content: bytes) -> Iterator[bytes]:
    """The JPEG pictures that follow each other in a motion-JPEG stream, whatever contains it."""
    at = content.find(b"\xff\xd8\xff")
    while at >= 0:
        end = content.find(b"\xff\xd9", at + 2)
        if end < 0:
            return
        yield content[at : end + 2]
        at = content.find(b"\xff\xd8\xff", end + 2)


def opencv_frames(content: bytes, folder: str) -> Iterator[bytes]:
    """Every frame of a video that OpenCV reads, as JPEG. It only opens files, so the video is one in the folder meanwhile."""
    import cv2

    path = os.path.join(folder, f"{uuid.uuid4().hex}.video")
    try:
        with open(path, "wb") as f:
            f.write(content)
        video = cv2.VideoCapture(path)
        try:
            if not video.isOpened():
                raise ValueError("OpenCV can't open it")
            while True:
                ok, frame = video.read()
                if not ok:
                    return
                yield cv2.imencode(".jpg", frame)[1].tobytes()
        finally:
            video.release()
    finally:
        if os.path.exists(path):
            os.remove(path)


def decode(content: bytes, folder: str) -> Iterator[bytes]:
    """The frames of a video: by OpenCV where it is installed, else of motion JPEG alone; ValueError for what isn't read."""
    if importlib.util.find_spec("cv2"):
        yield from opencv_frames(content, folder)
        return
    n = 0
    for n, data in enumerate(jpeg_frames(content), 1):
        yield data
    if not n:
        raise ValueError("no motion JPEG, and OpenCV isn't installed")


def frames(videos: DataFrame, decoder: Callable[[bytes], Iterator[bytes]] | None = None, strict: bool = False) -> DataFrame:
    """(path, frame_no, name, content) of every frame of videos (path, content), numbered from 0.

    What can't be read has no frames and is logged, or with strict fails. By default decode() reads them, with a folder
    that all executors share.
    """
    own = decoder or partial(decode, folder=run_dir(videos.sparkSession).removeprefix("file://"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    for i, data in enumerate(own(bytes(content or b""))):
                        yield pd.DataFrame({"path": [path], "frame_no": [i], "content": [data]})
                except Exception as e:
                    if strict:
                        raise RuntimeError(f"can't read {path}: {e}") from e
                    logging.getLogger(__name__).warning("can't read %s: %s", path, e)

    out = videos.select("path", "content").mapInPandas(run, "path string, frame_no int, content binary")
    return out.select("path", "frame_no", frame_name(F.col("frame_no")).alias("name"), "content")


def write_frames(found: DataFrame, folder: str) -> None:
    """Write each frame under its name into a folder that all executors share; a name that repeats is an error."""
    twice = found.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].name} would be written twice; give each video a folder")

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{r.name}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, os.path.join(folder, r.name))

    found.select("name", "content").foreachPartition(put)
