"""Numbers from image and container bytes, in Arrow batches. Decoding and models plug in as functions."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of an image that are measured, and padding of face boxes.
CENTRE_SHARE, FACE_PAD, CROP_PAD, LEAST_ROLL = 0.70, 10, 20, 2.0


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes of an ISO media file."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def rotation(data: bytes | None) -> int:
    """0, 90, 180 or 270: the turn of the video track's matrix; 0 where there is none."""
    if not data:
        return 0
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for track, c, d in boxes(data, a, b):
            if track != b"trak":
                continue
            matrix, video = None, False
            for k, e, f in boxes(data, c, d):
                if k == b"tkhd":
                    at = e + (52 if data[e] == 1 else 40)
                    if at + 8 <= f:
                        matrix = struct.unpack_from(">ii", data, at)
                elif k == b"mdia":
                    video |= any(h == b"hdlr" and data[g + 8 : g + 12] == b"vide" for h, g, _ in boxes(data, e, f))
            if video and matrix:
                return round(math.degrees(math.atan2(matrix[1], matrix[0])) / 90) * 90 % 360
    return 0


def sharpness(grey: np.ndarray) -> float | None:
    """Population variance of the 3x3 Laplacian, borders mirrored; null for an image without area."""
    if grey.size == 0:
        return None
    p = np.pad(grey.astype(np.float64), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def centre(grey: np.ndarray, share: float = CENTRE_SHARE) -> np.ndarray:
    h, w = grey.shape
    dy, dx = int(h * (1 - share) / 2), int(w * (1 - share) / 2)
    return grey[dy : h - dy, dx : w - dx]


def face_patch(grey: np.ndarray, x1: int, y1: int, x2: int, y2: int, pad: int = FACE_PAD) -> np.ndarray:
    h, w = grey.shape
    return grey[max(0, y1 - pad) : min(h, y2 + pad), max(0, x1 - pad) : min(w, x2 + pad)]


def difference_hash(grey: np.ndarray) -> int | None:
    """64 bits: whether each of 8x8 areas is brighter than its right neighbour. Areas are averaged, see the README."""
    h, w = grey.shape
    if h < 8 or w < 9:
        return None
    ys, xs = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
    mean = sums / np.outer(np.diff(ys), np.diff(xs))
    return int(np.packbits(mean[:, 1:] > mean[:, :-1]).view(">i8")[0])


def grey_image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Grey values of a row of Spark's image source, which is BGR."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]


def measure_images(images: DataFrame) -> DataFrame:
    """(origin, sharpness, code) of Spark's image source; images that cannot be decoded are not in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grey = [grey_image(*r) for r in zip(b["height"], b["width"], b["nChannels"], b["data"])]
            yield pd.DataFrame({"origin": b["origin"], "sharpness": [sharpness(centre(g)) for g in grey], "code": pd.array([difference_hash(g) for g in grey], dtype="Int64")})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "origin string, sharpness double, code long")


def rotations_of(df: DataFrame, content: str, name: str = "rotation") -> DataFrame:
    def run(c: pd.Series) -> pd.Series:
        return c.map(rotation)

    return df.withColumn(name, F.pandas_udf(run, "int")(F.col(content)))


def probe(df: DataFrame, content: str, function: Callable[[bytes], dict], schema: str) -> DataFrame:
    """Columns that a decoder finds in contents; a content it fails on gives nulls."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != content)

    def safe(c: bytes) -> dict:
        try:
            return function(c)
        except Exception:  # noqa: BLE001  (a broken file must not end the run)
            return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b.drop(columns=[content]).reset_index(drop=True), pd.DataFrame([safe(c) for c in b[content]], columns=names)], axis=1)

    return df.mapInPandas(run, f"{kinds}, {schema}")


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, pad: int = CROP_PAD) -> Column:
    """Padded box, kept inside the frame."""
    lo = lambda c: F.greatest(c - pad, F.lit(0))
    return F.struct(lo(x1).alias("x1"), lo(y1).alias("y1"), F.least(x2 + pad, w).alias("x2"), F.least(y2 + pad, h).alias("y2"))


def roll(left_x: Column, left_y: Column, right_x: Column, right_y: Column, sane: Column, least: float = LEAST_ROLL) -> Column:
    """Degrees by which eyes lie aslant, 0 below the least turn or where keypoints are not sane."""
    d = F.degrees(F.atan2(right_y - left_y, right_x - left_x))
    return F.when(sane & (F.abs(d) > least), d).otherwise(0.0)
