"""Image files and raw planes as frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrack.operators.images import luma_from_planes, yuv_to_argb


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder as frames, in the order of their names: width, height and packed ARGB pixels.

    Decoding is Spark's own image source; turning its BGR bytes into pixels is array work in Arrow batches.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def run(batches):
        for b in batches:
            out = []
            for w, h, n, d in zip(b.width, b.height, b.n, b.data):
                p = np.frombuffer(d, np.uint8).reshape(h * w, n).astype(np.int64)
                blue, green, red = (p[:, 0],) * 3 if n == 1 else (p[:, 0], p[:, 1], p[:, 2])
                alpha = p[:, 3] if n == 4 else np.full(len(p), 255)
                out.append((alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32).view(np.int32))
            yield pd.DataFrame({"origin": b.origin, "width": b.width, "height": b.height, "pixels": out})

    return raw.mapInPandas(run, "origin string, width int, height int, pixels array<int>")


def decode_yuv(raw: DataFrame, keys: list[str], data: str = "data", to: tuple[int, int] | None = None, luma_only: bool = False) -> DataFrame:
    """Frames from raw planes (width, height, stride, slice_height, layout I420 or NV12, data): ARGB, or luma from the Y plane only."""

    def run(batches):
        for b in batches:
            out, ws, hs = [], [], []
            for w, h, stride, sl, layout, d in zip(b.width, b.height, b.stride, b.slice_height, b.layout, b[data]):
                tw, th = to or (int(w), int(h))
                if luma_only:
                    y = luma_from_planes(d, int(w), int(h), int(stride))
                    p = y[np.arange(th)[:, None] * int(h) // th, np.arange(tw)[None, :] * int(w) // tw].astype(np.int32)
                else:
                    p = yuv_to_argb(d, int(w), int(h), int(stride), int(sl), layout, tw, th).astype(np.uint32).view(np.int32)
                out.append(p.ravel())
                ws.append(tw)
                hs.append(th)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "width": ws, "height": hs, "pixels": out})

    kinds = ", ".join(f"{k} {raw.schema[k].dataType.simpleString()}" for k in keys)
    return raw.select(*keys, "width", "height", "stride", "slice_height", "layout", data).mapInPandas(run, f"{kinds}, width int, height int, pixels array<int>")


def colour_layout(code: Column | str) -> Column:
    """Name of a decoder's colour format code."""
    x = F.col(code) if isinstance(code, str) else code
    return F.when(x == 19, "I420").when(x == 21, "NV12").otherwise("UNSUPPORTED")
