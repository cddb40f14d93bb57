"""Images of datasets as pixels: .npy arrays and .png files, depths in metres, and the cameras that took them."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fx, fy, cx, cy of the datasets' cameras. Fixed values.
CAMERAS = {"nyuv2": (518.8579, 519.4696, 325.5824, 253.7362), "sunrgbd": (570.0, 570.0, 320.0, 240.0)}

#: Channels of a PNG by its colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line (bytes) without its filter; step: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError(f"no such PNG filter: {kind}")
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            rise = left + up[i] - corner
            guess = min((abs(rise - left), 0, left), (abs(rise - up[i]), 1, up[i]), (abs(rise - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Height x width x channels of a PNG of 8 or 16 bits a channel, not interlaced. Palette images give the palette's index."""
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None:
        raise ValueError("a PNG without a header")
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or interlaced:
        raise ValueError(f"a PNG of {bits} bits{', interlaced' if interlaced else ''}, can't be read")
    step = CHANNELS[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * step + 1)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    return out.view(">u2" if bits == 16 else np.uint8).reshape(height, width, CHANNELS[colour])


def read_image(data: bytes) -> np.ndarray:
    """Height x width x channels, by what the file begins with."""
    if data.startswith(b"\x89PNG"):
        return read_png(data)
    if data.startswith(b"\x93NUMPY"):
        a = np.load(io.BytesIO(data), allow_pickle=False)
        return a[:, :, None] if a.ndim == 2 else a
    raise ValueError("neither a PNG nor a .npy file")


def pixels(found: DataFrame, content: str = "content", every: int = 1) -> DataFrame:
    """(stem, v, u, c, value) of images, every so many pixels both ways. Null contents have no pixels. A row of pixels at a time leaves the worker."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, data in zip(b["stem"], b[content], strict=True):
                if data is None:
                    continue
                a = read_image(bytes(data))
                for v in range(0, len(a), every):
                    line = a[v, ::every]
                    u, c = np.indices(line.shape)
                    yield pd.DataFrame({"stem": stem, "v": v, "u": u.ravel() * every, "c": c.ravel(), "value": line.astype(float).ravel()})

    return found.select("stem", content).mapInPandas(read, "stem string, v int, u int, c int, value double")


def metres(value: Column, dataset: str, largest: Column | None = None) -> Column:
    """Depth in metres: millimetres in nyuv2; in sunrgbd tenths of them where the image's largest value is over 100, else metres already."""
    if dataset == "nyuv2":
        return value / 1000.0
    if dataset == "sunrgbd":
        return F.when(largest > 100, value / 10000.0).otherwise(value)
    raise ValueError(f"no such dataset: {dataset}")


def depth_points(found: DataFrame, dataset: str, every: int = 1) -> DataFrame:
    """(stem, v, u, depth, x, y, z): points that the pixels of depth images (stem, depth) see, by the dataset's camera; pixels without depth have none."""
    d = pixels(found, "depth", every).where("c = 0")
    if dataset == "sunrgbd":
        d = d.join(d.groupBy("stem").agg(F.max("value").alias("largest")), "stem")
    d = d.withColumn("depth", metres(F.col("value"), dataset, F.col("largest") if dataset == "sunrgbd" else None)).where("depth > 0")
    fx, fy, cx, cy = CAMERAS[dataset]
    return d.select("stem", "v", "u", "depth", ((F.col("u") - cx) * F.col("depth") / fx).alias("x"), ((F.col("v") - cy) * F.col("depth") / fy).alias("y"), F.col("depth").alias("z"))
