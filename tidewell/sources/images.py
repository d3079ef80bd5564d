"""Image decoding, resolution and brightness grids.

Pillow decodes where it is installed. Without it, small PNG and BMP files are decoded in numpy as they are read; JPEG, TIFF
and other PNG files are set aside by digest, once each, and decoded by the JVM's readers. Nothing reads WebP then.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import difference_bits
from .scratch import run_dir, settle


#: Bytes of pixels from which a PNG whose rows build on their left neighbours isn't decoded here.
SLOW = 2_000_000


def unfilter(kind: int, line: list[int], up: list[int], bands: int) -> bytes:
    """A row of a PNG whose bytes were stored as differences from an average (3) or from the likeliest neighbour (4)."""
    row = [0] * bands + line
    above = [0] * bands + up
    for x in range(bands, len(row)):
        left, top = row[x - bands], above[x]
        if kind == 3:
            guess = (left + top) >> 1
        else:
            corner = above[x - bands]
            by_left, by_top, by_corner = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
            guess = left if by_left <= by_top and by_left <= by_corner else top if by_top <= by_corner else corner
        row[x] = (row[x] + guess) & 255
    return bytes(row[bands:])


def png(data: bytes) -> np.ndarray:
    """Brightness of a PNG of 8 bits a channel that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    w, h, depth, colour, _, _, laced = head
    if depth != 8 or laced:
        raise NotImplementedError("only 8 bits a channel, not interlaced")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * bands)
    if raw.size > SLOW and np.isin(raw[:, 0], (3, 4)).any():
        raise NotImplementedError("too large to undo its filters here")
    out = np.zeros((h, w * bands), np.uint8)
    up = np.zeros(w * bands, np.uint8)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:]
        if f == 0:
            out[y] = line
        elif f == 1:  # sums along the row, band by band, modulo 256
            out[y] = np.cumsum(line.reshape(w, bands), axis=0, dtype=np.uint8).ravel()
        elif f == 2:
            out[y] = line + up
        else:
            out[y] = np.frombuffer(unfilter(int(f), line.tolist(), up.tolist(), bands), np.uint8)
        up = out[y]
    px = out.reshape(h, w, bands)
    if colour == 3:
        px = palette[px[:, :, 0]]
    return px[:, :, 0].astype(np.float64) if colour in (0, 4) else luma(px[:, :, :3])


def bmp(data: bytes) -> np.ndarray:
    """Brightness of an uncompressed BMP of 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    start, size, w, h, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise NotImplementedError("only 24 and 32 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return luma((px if h < 0 else px[::-1])[:, :, 2::-1])


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.floor((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 32768) / 65536)


def brightness(data: bytes) -> np.ndarray:
    """An image as rows of brightness; ValueError if it can't be read, NotImplementedError if its kind isn't read here."""
    try:
        from PIL import Image
    except ImportError:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png(data)
        if data[:2] == b"BM":
            return bmp(data)
        if kind(data):
            raise NotImplementedError("Pillow isn't installed") from None
        raise ValueError("no image") from None
    with Image.open(io.BytesIO(data)) as im:
        im.load()
        return np.asarray(im.convert("L"), dtype=np.float64)


def kind(data: bytes) -> str:
    """The extension that fits an image's first bytes; empty for anything else."""
    heads = ((b"\x89PNG\r\n\x1a\n", ".png"), (b"BM", ".bmp"), (b"\xff\xd8\xff", ".jpg"), (b"II*\0", ".tif"), (b"MM\0*", ".tif"))
    return next((e for h, e in heads if data.startswith(h)), ".webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else "")


def header_size(data: bytes) -> tuple[int, int]:
    """Width and height as an image's header has them, also if the rest is cut short; ValueError without them."""
    try:
        match kind(data):
            case ".png":
                return struct.unpack(">II", data[16:24])
            case ".bmp":
                w, h = struct.unpack("<ii", data[18:26])
                return w, abs(h)
            case ".jpg":
                at = 2
                while at + 9 <= len(data):
                    mark = data[at + 1]
                    if data[at] != 0xFF or mark == 0xFF:
                        at += 1
                    elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                        h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                        return w, h
                    else:
                        at += 2 if 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            case ".tif":
                e = "<" if data[:2] == b"II" else ">"
                at = struct.unpack(e + "I", data[4:8])[0]
                found = {}
                for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
                    tag, form, _, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
                    found[tag] = struct.unpack(e + ("H" if form == 3 else "I"), value[: 2 if form == 3 else 4])[0]
                return found[256], found[257]
            case ".webp":
                if data[12:16] == b"VP8X":
                    return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
                if data[12:16] == b"VP8L":
                    bits = int.from_bytes(data[21:25], "little")
                    return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
                w, h = struct.unpack("<HH", data[26:30])
                return w & 0x3FFF, h & 0x3FFF
    except (struct.error, KeyError):
        pass
    raise ValueError("no image, or one whose header is cut short")


def kernel(n: int, to: int) -> np.ndarray:
    """Weights (to x n) of Lanczos resampling over three lobes, widened when shrinking."""
    scale = max(n / to, 1.0)
    centre = (np.arange(to) + 0.5) * n / to
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def grid(px: np.ndarray, width: int = 9, height: int = 8) -> np.ndarray:
    """Brightness resampled to width x height whole numbers, columns first."""
    tight = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    if px.shape[1] != width:
        px = tight(px @ kernel(px.shape[1], width).T)
    if px.shape[0] != height:
        px = tight(kernel(px.shape[0], height) @ px)
    return px


#: Types that need no session, so that the module can be imported before there is one.
MEASURED = T.StructType().add("w", "integer").add("h", "integer").add("grid", T.ArrayType(T.IntegerType())).add("status", "string")
SIZED = T.StructType().add("w", "integer").add("h", "integer").add("error", "string")
#: Kinds that the JVM reads.
ASIDE = (".png", ".bmp", ".jpg", ".tif")


def measured(data: bytes | None, sha256: str | None, aside: str | None = None) -> tuple[int, int, list[int], str]:
    """(w, h, grid, status) of one image. What isn't read here is written to the folder `aside`, if its kind is among ASIDE."""
    try:
        px = brightness(bytes(data or b""))
        return px.shape[1], px.shape[0], grid(px).astype(int).ravel().tolist(), "ok"
    except NotImplementedError:
        if aside is None or sha256 is None or (e := kind(data)) not in ASIDE:
            return 0, 0, [0] * 72, "unsupported"
        path = os.path.join(aside, sha256 + e)
        if not os.path.exists(path):
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
        return 0, 0, [0] * 72, "aside"
    except Exception:
        return 0, 0, [0] * 72, "undecodable"


@F.pandas_udf(SIZED)
def _sized(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append((*header_size(bytes(data or b"")), None))
        except ValueError as e:
            rows.append((0, 0, str(e)))
    return pd.DataFrame(rows, columns=["w", "h", "error"])


def with_size(files: DataFrame) -> DataFrame:
    """Files (content, ...) with the w and h that their headers tell; both 0 where they tell none."""
    return files.withColumn("__m", _sized("content")).select(*files.columns, "__m.w", "__m.h")


@F.pandas_udf(MEASURED)
def _pixels(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = []
    for w, h, n, raw in zip(width, height, channels, data, strict=True):
        if w <= 0 or h <= 0:
            rows.append((0, 0, [0] * 72, "undecodable"))
            continue
        px = np.frombuffer(raw, np.uint8).reshape(h, w, n)
        y = px[:, :, 0].astype(np.float64) if n == 1 else luma(px[:, :, 2::-1])
        rows.append((w, h, grid(y).astype(int).ravel().tolist(), "ok"))
    return pd.DataFrame(rows, columns=["w", "h", "grid", "status"])


def decoded(spark: SparkSession, aside: str) -> DataFrame:
    """(sha256, m) of the images in a folder, named by digest, by the JVM's readers."""
    found = spark.read.format("image").load(aside).select("image.*")
    sha = F.regexp_extract("origin", r"([0-9a-f]{64})\.[a-z]+$", 1)
    return found.select(sha.alias("sha256"), _pixels("width", "height", "nChannels", "data").alias("m"))


def with_metadata(files: DataFrame, undecodable: str = "cluster", aside: str | None = None) -> DataFrame:
    """Files (content, ...) with w, h, res, dhash and status. Each file is read once and its bytes are never shuffled.

    What can't be decoded has size 0 and hash 0, and so clusters with its like and with flat images; undecodable="keep"
    gives it a null hash instead, "error" fails. Kinds that nothing here reads are `unsupported` and never cluster. Files
    that were measured as they were read come without content, and with the folder where some were set aside.
    """
    spark = files.sparkSession
    if aside is not None:
        first = files
    else:
        aside = made_aside(spark)
        here = F.pandas_udf(lambda content, sha: pd.DataFrame([measured(None if d is None else bytes(d), s, aside) for d, s in zip(content, sha, strict=True)], columns=["w", "h", "grid", "status"]), MEASURED)
        first = files.withColumn("__m", here("content", "sha256")).select(*[c for c in files.columns if c != "content"], "__m.*")
    first = settle(first)  # after this the folder holds all that was set aside
    if os.path.isdir(aside) and os.listdir(aside):
        late = decoded(spark, aside).select("sha256", F.col("m").alias("__m"))
        odd = first.where("status = 'aside'").drop("w", "h", "grid", "status").join(late, "sha256", "left")
        lost = F.struct(F.lit(0).alias("w"), F.lit(0).alias("h"), F.array_repeat(F.lit(0), 72).alias("grid"), F.lit("undecodable").alias("status"))
        odd = odd.withColumn("__m", F.coalesce("__m", lost)).select(*[c for c in odd.columns if c != "__m"], "__m.*")
        first = first.where("status <> 'aside'").unionByName(settle(odd))
        shutil.rmtree(aside, ignore_errors=True)
    # a file that could not even be read has no digest
    out = first.withColumns({"status": F.when(F.col("sha256").isNull(), "unreadable").otherwise(F.col("status")), "res": F.col("w").cast("long") * F.col("h"), "dhash": difference_bits(F.col("grid"))}).drop("grid")
    bad = F.col("status").isin("undecodable", "unreadable")
    if undecodable == "error":
        out = out.withColumn("dhash", F.when(bad, F.raise_error(F.concat(F.lit("can't decode "), "path"))).otherwise(F.col("dhash")))
    own = F.xxhash64("path")  # a hash that only this path has
    return out.withColumn("dhash", F.when((F.col("status") == "unsupported") | (bad & F.lit(undecodable == "keep")), own).otherwise(F.coalesce("dhash", F.lit(0).cast("long"))))


def made_aside(spark: SparkSession) -> str:
    """A new folder, shared by all executors, for images that the JVM is to decode."""
    path = os.path.join(run_dir(spark).removeprefix("file://"), f"aside-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
