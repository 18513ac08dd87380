"""Frames: masks, morphology, components and their shapes, background, shifts, signatures, planes, detectors."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of the 64-bit FNV-1a hash
BLOB = "array<struct<area:int,cx:double,cy:double,left:int,top:int,right:int,bottom:int,compactness:double>>"


@dataclass(frozen=True)
class BlobConfig:
    """Colour threshold, region and gates of the blob detector."""

    hue: float = 0.0
    saturation: float = 1.0
    value: float = 1.0
    hue_tol: float = 8.0
    s_tol: float = 0.1
    v_tol: float = 0.1
    region: tuple[int, int, int, int] | None = None
    min_area: int = 1
    max_area: int = 1 << 30
    min_compactness: float = 0.0
    max_pixels: int = 80_000
    max_components: int = 512


# --- kernels on arrays [height, width]


def hsv_planes(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = ((argb >> s & 255) / 255.0 for s in (16, 8, 0))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d == 0, 1, d)
    hue = np.where(d == 0, 0.0, np.where(top == r, ((g - b) / safe + 6) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60)
    return hue, np.where(top == 0, 0.0, d / np.where(top == 0, 1, top)), top


def threshold_mask(argb: np.ndarray, c: BlobConfig) -> np.ndarray:
    h, s, v = hsv_planes(argb)
    d = np.abs(h - c.hue % 360)
    return (np.minimum(d, 360 - d) <= c.hue_tol) & (np.abs(s - c.saturation) <= c.s_tol) & (np.abs(v - c.value) <= c.v_tol)


def luma_plane(argb: np.ndarray) -> np.ndarray:
    return ((argb >> 16 & 255) * 299 + (argb >> 8 & 255) * 587 + (argb & 255) * 114) // 1000


def region_mask(shape: tuple[int, int], region) -> np.ndarray:
    m = np.zeros(shape, bool)
    left, top, right, bottom = region
    m[max(0, top) : max(0, bottom), max(0, left) : max(0, right)] = True
    return m


def polygon_mask(shape: tuple[int, int], points) -> np.ndarray:
    """Pixels whose centre lies inside the polygon."""
    y, x = np.mgrid[: shape[0], : shape[1]] + 0.5
    inside = np.zeros(shape, bool)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def _around(mask: np.ndarray, radius: int, every: bool) -> np.ndarray:
    padded = np.pad(mask, radius)
    out = np.full(mask.shape, every)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            part = padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
            out = out & part if every else out | part
    return out


def erode(mask, radius=1):
    """Square element; what lies outside the image counts as background."""
    return _around(mask, radius, True)


def dilate(mask, radius=1):
    return _around(mask, radius, False)


def opened(mask, radius=1):
    return dilate(erode(mask, radius), radius)


def closed(mask, radius=1):
    return erode(dilate(mask, radius), radius)


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components numbered from 1 in the order of their first pixel; by runs of rows and union-find."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = list(range(len(ys)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(mask.shape, np.int32), {}
    for k, (y, a, b) in enumerate(zip(ys.tolist(), starts.tolist(), ends.tolist())):
        out[y, a:b] = names.setdefault(root(k), len(names) + 1)
    return out


def components(mask: np.ndarray) -> list[dict]:
    """Area, centroid, bounds and compactness of each component, in label order."""
    lab = label(mask)
    y, x = np.nonzero(lab)
    k = lab[y, x] - 1
    n = int(lab.max())
    area = np.bincount(k, minlength=n)
    low = lambda v: np.full(n, 1 << 30).tolist() if not n else [int(z) for z in np.minimum.reduceat(v[np.argsort(k, kind="stable")], np.cumsum(area) - area)]
    high = lambda v: [int(z) for z in np.maximum.reduceat(v[np.argsort(k, kind="stable")], np.cumsum(area) - area)]
    if not n:
        return []
    cx, cy = np.bincount(k, x, n) / area, np.bincount(k, y, n) / area
    out = []
    for i, (a, l, t, r, b) in enumerate(zip(area.tolist(), low(x), low(y), high(x), high(y))):
        out.append({"area": a, "cx": float(cx[i]), "cy": float(cy[i]), "left": l, "top": t, "right": r, "bottom": b, "compactness": a / ((r - l + 1) * (b - t + 1))})
    return out


def axis_ratio(x: np.ndarray, y: np.ndarray) -> float:
    """Ratio of the principal axes of a pixel set, 1 at least."""
    a, b, c = x.var(), y.var(), ((x - x.mean()) * (y - y.mean())).mean()
    mid, off = (a + b) / 2, np.sqrt(((a - b) / 2) ** 2 + c * c)
    return float(max(1.0, np.sqrt(max(mid + off, 1e-6) / max(mid - off, 1e-6))))


def hull_solidity(x: np.ndarray, y: np.ndarray) -> float:
    """Area over the area of the convex hull of the pixels' corners."""
    p = sorted({(i + a, j + b) for i, j in zip(x.tolist(), y.tolist()) for a in (0, 1) for b in (0, 1)})

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    hull = half(p)[:-1] + half(p[::-1])[:-1]
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, [*hull[1:], hull[0]]))) / 2
    return len(x) / area if area else 0.0


def roundness(mask: np.ndarray) -> float:
    """Of one component: the larger of 4 pi A / P squared and the share of empty corners of its bounds (0..1)."""
    y, x = np.nonzero(mask)
    box = mask[y.min() : y.max() + 1, x.min() : x.max() + 1]
    p = sum(int(np.diff(np.pad(box, 1).astype(np.int8), axis=a).astype(bool).sum()) for a in (0, 1))
    k = max(1, min(box.shape) // 4)
    corners = np.concatenate([box[a, b].ravel() for a in (slice(0, k), slice(-k, None)) for b in (slice(0, k), slice(-k, None))])
    return float(min(1.0, max(4 * np.pi * box.sum() / p**2, 1 - corners.mean())))


def circular_mean(degrees: np.ndarray) -> float:
    a = np.radians(degrees)
    return float(np.degrees(np.arctan2(np.sin(a).mean(), np.cos(a).mean())) % 360)


def upper_median_plane(planes: np.ndarray) -> np.ndarray:
    return np.sort(planes, axis=0)[len(planes) // 2]


def moving_mask(masks: np.ndarray, i: int, persistent: np.ndarray) -> np.ndarray:
    """What differs from the frame before or after, grown by one, within the frame's mask and without what persists."""
    change = np.zeros(masks[i].shape, bool)
    for j in (i - 1, i + 1):
        if 0 <= j < len(masks):
            change |= masks[i] ^ masks[j]
    return dilate(change) & masks[i] & ~persistent


def persistent_mask(masks: np.ndarray, least: int, share: float) -> np.ndarray:
    return masks.sum(axis=0) >= max(least, int(np.ceil(len(masks) * share)))


def structure_mask(plane: np.ndarray, least: int = 24) -> np.ndarray:
    """Pixels with a neighbour whose luma differs by ``least`` or more."""
    out = np.zeros(plane.shape, bool)
    d = np.abs(np.diff(plane.astype(int), axis=1)) >= least
    out[:, 1:] |= d
    out[:, :-1] |= d
    d = np.abs(np.diff(plane.astype(int), axis=0)) >= least
    out[1:] |= d
    out[:-1] |= d
    return out


def dominant_shift(a: np.ndarray, b: np.ndarray, reach: int = 2, stride: int = 1) -> tuple[int, int]:
    """(dx, dy) of the least mean difference between strided samples of both planes; ties: the smaller shift, then order."""
    best = None
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            p = a[reach:-reach:stride, reach:-reach:stride].astype(int)
            q = b[reach + dy : b.shape[0] - reach + dy : stride, reach + dx : b.shape[1] - reach + dx : stride].astype(int)
            rank = (float(np.abs(p - q).mean()), abs(dx) + abs(dy), dy, dx)
            if best is None or rank < best:
                best = rank
    return best[3], best[2]


def merge_boxes(blobs: list[dict], grow: int) -> list[list[int]]:
    """Groups of blobs whose bounds, grown by ``grow``, overlap, transitively."""
    parent = list(range(len(blobs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(blobs):
        for j in range(i):
            q = blobs[j]
            if p["left"] - grow <= q["right"] + grow and q["left"] - grow <= p["right"] + grow and p["top"] - grow <= q["bottom"] + grow and q["top"] - grow <= p["bottom"] + grow:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(len(blobs)):
        groups.setdefault(root(i), []).append(i)
    return list(groups.values())


def fnv1a(values) -> int:
    h = FNV_BASIS
    for v in values:
        h = ((h ^ (int(v) & 0xFFFFFFFF)) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def luma_from_planes(raw: bytes, w: int, h: int, stride: int) -> np.ndarray:
    """The Y plane only, its row padding left out."""
    need = stride * (h - 1) + w
    return np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8, need), (h, w), (stride, 1)).copy()


def yuv_to_argb(raw: bytes, w: int, h: int, stride: int, slice_h: int, layout: str, to_w: int, to_h: int) -> np.ndarray:
    """ARGB [to_h, to_w] from I420 or NV12 bytes (BT.601, video range), nearest neighbour."""
    y = luma_from_planes(raw, w, h, stride)
    rest = np.frombuffer(raw, np.uint8)[stride * slice_h :]
    r, q = np.arange(h) // 2, np.arange(w) // 2
    if layout == "NV12":
        u, v = (rest[(r[:, None] * stride) + 2 * q[None, :] + k] for k in (0, 1))
    else:
        half, size = stride // 2, (stride // 2) * (slice_h // 2)
        u, v = (rest[k * size + r[:, None] * half + q[None, :]] for k in (0, 1))
    yy, uu, vv = (y.astype(int) - 16) * 298, u.astype(int) - 128, v.astype(int) - 128
    rgb = [((yy + 128 + k).clip(0, None) >> 8).clip(0, 255) for k in (409 * vv, -100 * uu - 208 * vv, 516 * uu)]
    out = (255 << 24) | rgb[0] << 16 | rgb[1] << 8 | rgb[2]
    return out[np.arange(to_h)[:, None] * h // to_h, np.arange(to_w)[None, :] * w // to_w].astype(np.int64)


# --- DataFrame operators


def frame_reason(pixels, w: int, h: int, c: BlobConfig) -> str | None:
    return "INVALID_INPUT" if w <= 0 or h <= 0 or pixels is None or len(pixels) != w * h else None


def detect_frame(pixels, w: int, h: int, c: BlobConfig) -> tuple[str | None, list[dict]]:
    """Reason (null: none) and the blobs that pass the gates."""
    if bad := frame_reason(pixels, w, h, c):
        return bad, []
    region = c.region or (0, 0, w, h)
    inside = region_mask((h, w), region)
    if not inside.any():
        return "INVALID_INPUT", []
    mask = threshold_mask(np.asarray(pixels, np.int64).reshape(h, w), c) & inside
    if int(mask.sum()) > c.max_pixels:
        return "RESOURCE_LIMIT", []
    found = components(mask)
    if len(found) > c.max_components:
        return "RESOURCE_LIMIT", []
    return None, [b for b in found if c.min_area <= b["area"] <= c.max_area and b["compactness"] >= c.min_compactness]


def detect_blobs(frames: DataFrame, config: BlobConfig, keys: tuple[str, ...] = ("clip_id", "frame_index")) -> DataFrame:
    """Per frame (keys, t_s, width, height, pixels): kind (null: blobs found their way through) and blobs. No shuffle."""
    names = [*keys, "t_s"]

    def run(batches):
        for b in batches:
            got = [detect_frame(p, w, h, config) for p, w, h in zip(b.pixels, b.width, b.height)]
            yield pd.DataFrame({**{n: b[n] for n in names}, "width": b.width, "height": b.height, "kind": [k for k, _ in got], "blobs": [v for _, v in got]})

    kinds = ", ".join(f"{n} {frames.schema[n].dataType.simpleString()}" for n in names)
    return frames.select(*names, "width", "height", "pixels").mapInPandas(run, f"{kinds}, width int, height int, kind string, blobs {BLOB}")


def single_blob(blobs: DataFrame) -> DataFrame:
    """Per frame the only blob, or why there is none: NO_BLOB, AMBIGUOUS_BLOBS or the detector's reason."""
    n = F.size("blobs")
    kind = F.coalesce(F.col("kind"), F.when(n == 0, "NO_BLOB").when(n > 1, "AMBIGUOUS_BLOBS"))
    return blobs.withColumn("kind", kind).withColumn("blob", F.when(F.col("kind").isNull(), F.get("blobs", F.lit(0)))).drop("blobs")


def explode_pixels(planes: DataFrame, keys: list[str], pixels: str, width: int) -> DataFrame:
    """Pixel rows (px, py, luma) of small planes."""
    return planes.select(*keys, F.posexplode(pixels).alias("pos", "luma")).withColumns({"px": F.pmod("pos", F.lit(width)), "py": F.floor(F.col("pos") / width).cast("int")}).drop("pos")


def median_background(pixels: DataFrame, clip: str) -> DataFrame:
    """Upper median of each pixel over a clip's frames."""
    v = F.array_sort(F.collect_list("luma"))
    return pixels.groupBy(clip, "px", "py").agg(F.get(v, F.floor(F.size(v) / 2).cast("int")).alias("background"))


def foreground(pixels: DataFrame, background: DataFrame, clip: str, least: int) -> DataFrame:
    return pixels.join(background, [clip, "px", "py"]).where(F.abs(F.col("luma") - F.col("background")) >= least)


def persistent_pixels(mask: DataFrame, frames: DataFrame, clip: str, least: int, share: float) -> DataFrame:
    """Pixels that are set in at least max(least, ceil(frames * share)) frames of their clip."""
    n = frames.groupBy(clip).agg(F.count(F.lit(1)).alias("frames"))
    c = mask.groupBy(clip, "px", "py").agg(F.count(F.lit(1)).alias("hits")).join(n, clip)
    return c.where(F.col("hits") >= F.greatest(F.lit(least), F.ceil(F.col("frames") * share))).select(clip, "px", "py", "hits")


def shift_scores(a: DataFrame, b: DataFrame, key: str, reach: int) -> DataFrame:
    """Mean difference of each whole-pixel shift of b against a (rows px, py, luma), and the best one of each key."""
    s = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = a.withColumn("dx", s).withColumn("dy", s).withColumns({"qx": F.col("px") + F.col("dx"), "qy": F.col("py") + F.col("dy")})
    j = moved.join(b.select(key, F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("luma").alias("other")), [key, "qx", "qy"])
    c = j.groupBy(key, "dx", "dy").agg(F.avg(F.abs(F.col("luma") - F.col("other"))).alias("cost"))
    best = F.min_by(F.struct("dx", "dy", "cost"), F.struct("cost", F.abs(F.col("dx")) + F.abs(F.col("dy")), "dy", "dx"))
    return c.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def component_stats(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid, bounds, compactness, axis ratio and spread of labelled pixel rows (px, py)."""
    g = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.min("px").alias("left"), F.min("py").alias("top"), F.max("px").alias("right"), F.max("py").alias("bottom"),
        F.var_pop("px").alias("vx"), F.var_pop("py").alias("vy"), F.covar_pop("px", "py").alias("cxy"),
    )
    mid, off = (F.col("vx") + F.col("vy")) / 2, F.sqrt(((F.col("vx") - F.col("vy")) / 2) * ((F.col("vx") - F.col("vy")) / 2) + F.col("cxy") * F.col("cxy"))
    ratio = F.greatest(F.lit(1.0), F.sqrt(F.greatest(mid + off, F.lit(1e-6)) / F.greatest(mid - off, F.lit(1e-6))))
    box = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    return g.withColumns({"compactness": F.col("area") / box, "axis_ratio": ratio}).drop("vx", "vy", "cxy")


def signatures(frames: DataFrame, keys: list[str], pixels: str) -> DataFrame:
    """Order-dependent 64-bit hash (hex), checksum modulo 2^63 and luma range of each pixel array."""

    def run(batches):
        for b in batches:
            rows = []
            for p in b[pixels]:
                v = np.asarray(p if p is not None else [], np.int64)
                y = luma_plane(v) if len(v) else np.zeros(1, int)
                rows.append((f"{fnv1a(v):016x}", int((v & 0xFFFFFFFF).sum()) & (1 << 63) - 1, int(y.max() - y.min())))
            yield pd.DataFrame({**{k: b[k] for k in keys}, "signature": [r[0] for r in rows], "checksum": [r[1] for r in rows], "luma_range": [r[2] for r in rows]})

    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, pixels).mapInPandas(run, f"{kinds}, signature string, checksum long, luma_range int")


def signature_verdict(signed: DataFrame, key: str, order: str, expected: int, least_range: int = 1) -> DataFrame:
    """BLANK, STALE, MISSING or VALID of each sequence of signatures."""
    g = signed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("signature").alias("different"), F.min("luma_range").alias("range"))
    return g.withColumn("verdict", F.when(F.col("n") != expected, "MISSING").when(F.col("range") < least_range, "BLANK").when(F.col("different") < F.col("n"), "STALE").otherwise("VALID"))


def sequence_identity(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """SHA-256 over a sequence's ordered rows. A sequence is a clip: its rows fit one group."""
    line = F.concat_ws(",", *columns)
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s")))).alias("r"))
    return g.select(key, F.size("r").alias("rows"), F.sha2(F.array_join(F.transform("r", lambda x: x.s), ";"), 256).alias("identity"))


def source_validity(pixels: DataFrame, clip: str, frame: str, bright: int = 200, dark_mean: float = 4.0) -> DataFrame:
    """Two levels of sums, frame then clip: mean luma, bright share, brightest frame, and BLACK_FRAMES where all is dark."""
    f = pixels.groupBy(clip, frame).agg(F.sum("luma").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("luma") >= bright).alias("b"))
    g = f.groupBy(clip).agg((F.sum("s") / F.sum("n")).alias("mean_luma"), (F.sum("b") / F.sum("n")).alias("bright_share"), F.max(F.col("s") / F.col("n")).alias("brightest_frame"))
    return g.withColumn("verdict", F.when(F.col("brightest_frame") < dark_mean, "BLACK_FRAMES").otherwise("VALID"))


def motion_gate(shifts: DataFrame, clip: str, median_limit: float, max_limit: float) -> DataFrame:
    m = F.hypot("dx", "dy")
    g = shifts.groupBy(clip).agg(F.median(m).alias("median_shift"), F.max(m).alias("max_shift"))
    return g.withColumn("moved", (F.col("median_shift") > median_limit) | (F.col("max_shift") > max_limit))


def level_snapshot(gravity: DataFrame, key: str, gx: str, gy: str, gz: str, gyro: str | None, rotation: int = 0, least: int = 12, band: tuple[float, float] = (6.0, 13.0), still: float = 0.25) -> DataFrame:
    """Roll and pitch in degrees from mean gravity turned into the display's axes, or the reason why not."""
    g = gravity.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(gx).alias("x"), F.avg(gy).alias("y"), F.avg(gz).alias("z"), (F.max(gyro) if gyro else F.lit(0.0)).alias("gyro"))
    dx, dy = {0: ("x", "y"), 90: ("-y", "x"), 180: ("-x", "-y"), 270: ("y", "-x")}[rotation % 360]
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    reason = F.when(F.col("n") < least, "TOO_FEW_SAMPLES").when(~size.between(*band), "BAD_GRAVITY").when(F.col("gyro") > still, "MOVING")
    g = g.withColumns({"reason": reason, "dx": F.expr(dx), "dy": F.expr(dy)})
    roll, pitch = F.degrees(F.atan2("dx", "dy")), F.degrees(F.atan2(F.col("z"), F.hypot("dx", "dy")))
    return g.select(key, "n", "reason", F.when(F.col("reason").isNull(), roll).alias("roll"), F.when(F.col("reason").isNull(), pitch).alias("pitch"))


def rolling_level(gravity: DataFrame, key: str, order: str, gx: str, gy: str, rows: int = 30) -> DataFrame:
    """Roll over the last ``rows`` samples at each sample."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return gravity.withColumn("roll", F.degrees(F.atan2(F.avg(gx).over(w), F.avg(gy).over(w))))


@dataclass(frozen=True)
class MotionConfig:
    """Gates of the motion and the physical detector."""

    foreground: int = 24
    min_area: int = 2
    max_area: int = 400
    keep: int = 6
    max_shift: float = 1.5
    max_single_shift: float = 4.0
    expected: tuple[float, float, float] | None = None  # area, short side and long side of the ball in pixels
    area_ratio: tuple[float, float] = (0.35, 2.5)
    side_delta: float = 1.0
    persistent_frames: int = 3
    persistent_share: float = 0.6
    min_solidity: float = 0.6
    min_roundness: float = 0.35
    max_axis_ratio: float = 3.0
    merge: int = 1


def expected_size_score(blob: dict, c: MotionConfig) -> float | None:
    """1 for a blob of the expected sides, less by the larger relative error; None where area or sides are out of bounds."""
    area, short, long = c.expected
    sides = sorted((blob["right"] - blob["left"] + 1, blob["bottom"] - blob["top"] + 1))
    off = max(abs(sides[0] / short - 1), abs(sides[1] / long - 1))
    fits = c.area_ratio[0] <= blob["area"] / area <= c.area_ratio[1] and off <= c.side_delta
    return min(1.0, max(0.0, 1 - off)) if fits else None


def camera_moved(planes: np.ndarray, c: MotionConfig) -> bool:
    """Upper median or largest shift between neighbouring planes over its limit; planes too small for the search don't tell."""
    if len(planes) < 2 or min(planes[0].shape) <= 6:
        return False
    size = sorted(float(np.hypot(*dominant_shift(a, b))) for a, b in zip(planes, planes[1:]))
    return size[len(size) // 2] > c.max_shift or size[-1] > c.max_single_shift


def motion_detect(planes: np.ndarray, c: MotionConfig) -> tuple[str | None, list[list[dict]]]:
    """Blobs that differ from the temporal median, opened and closed, best six a frame by area and compactness."""
    if len(planes) < 3:
        return "INSUFFICIENT_FRAMES", []
    if camera_moved(planes, c):
        return "CAMERA_MOTION", []
    background, out = upper_median_plane(planes), []
    for p in planes:
        mask = closed(np.abs(p.astype(int) - background) >= c.foreground)
        found = [b for b in components(mask) if c.min_area <= b["area"] <= c.max_area and (c.expected is None or expected_size_score(b, c) is not None)]
        out.append(sorted(found, key=lambda b: -(b["area"] ** 0.5 + 2 * b["compactness"]))[: c.keep])
    return None, out


def physical_detect(masks: np.ndarray, c: MotionConfig) -> tuple[str | None, list[list[dict]]]:
    """Moving, not persistent fragments, merged, that are solid, round and compact enough."""
    if len(masks) < 3:
        return "INSUFFICIENT_FRAMES", []
    still, out = persistent_mask(masks, c.persistent_frames, c.persistent_share), []
    for i in range(len(masks)):
        moving = moving_mask(masks, i, still)
        lab, found = label(moving), components(moving)
        kept = []
        for group in merge_boxes(found, c.merge):
            one = np.isin(lab, [g + 1 for g in group])
            y, x = np.nonzero(one)
            if c.min_area <= len(x) <= c.max_area and axis_ratio(x, y) <= c.max_axis_ratio and hull_solidity(x, y) >= c.min_solidity and roundness(one) >= c.min_roundness:
                box = (int(x.min()), int(y.min()), int(x.max()), int(y.max()))
                kept.append({"area": len(x), "cx": float(x.mean()), "cy": float(y.mean()), "left": box[0], "top": box[1], "right": box[2], "bottom": box[3], "compactness": len(x) / ((box[2] - box[0] + 1) * (box[3] - box[1] + 1))})
        out.append(kept)
    return None, out


def detect_in_clips(frames: DataFrame, kind: str, config: MotionConfig | None = None, threshold: int = 128) -> DataFrame:
    """Motion or physical detection over whole clips (clip_id, frame_index, t_s, width, height, pixels as luma). A clip is at most 240 frames."""
    c = config or MotionConfig()

    def run(k, pdf):
        pdf = pdf.sort_values("frame_index").reset_index(drop=True)
        planes = np.stack([np.asarray(p).reshape(h, w) for p, w, h in zip(pdf.pixels, pdf.width, pdf.height)])
        reason, found = motion_detect(planes, c) if kind == "motion" else physical_detect(planes >= threshold, c)
        return pd.DataFrame({"clip_id": pdf.clip_id, "frame_index": pdf.frame_index, "t_s": pdf.t_s, "width": pdf.width, "height": pdf.height, "kind": reason, "blobs": found or [[] for _ in range(len(pdf))]})

    ids = frames.schema["clip_id"].dataType.simpleString()
    return frames.groupBy("clip_id").applyInPandas(run, f"clip_id {ids}, frame_index int, t_s double, width int, height int, kind string, blobs {BLOB}")


def text_digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
