"""Packed colours, hue, luma, thresholds, polygons and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotrack.functions.numeric import all_finite, c, circular_distance


def pack(alpha, red, green, blue) -> Column:
    """Signed 32-bit ARGB."""
    v = F.shiftleft(c(alpha).cast("long"), 24).bitwiseOR(F.shiftleft(c(red).cast("long"), 16)).bitwiseOR(F.shiftleft(c(green).cast("long"), 8)).bitwiseOR(c(blue).cast("long"))
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")


def channels(argb) -> tuple[Column, Column, Column]:
    v = c(argb)
    return F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255)


def hsv(argb) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in 0..1."""
    r, g, b = (x / 255.0 for x in channels(argb))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = (
        F.when(d == 0, F.lit(0.0))
        .when(top == r, F.pmod(F.try_divide(g - b, d) + 6.0, F.lit(6.0)) * 60.0)
        .when(top == g, (F.try_divide(b - r, d) + 2.0) * 60.0)
        .otherwise((F.try_divide(r - g, d) + 4.0) * 60.0)
    )
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(d, top)), top


def hsv_matches(h, s, v, hue: float, saturation: float, value: float, hue_tol: float, s_tol: float, v_tol: float) -> Column:
    """Inclusive threshold around a colour; hue is circular, other than finite colours don't match."""
    near = (circular_distance(h, F.lit(hue)) <= hue_tol) & (F.abs(c(s) - saturation) <= s_tol) & (F.abs(c(v) - value) <= v_tol)
    return all_finite(h, s, v) & near


def luma_thousandths(argb) -> Column:
    """(299 R + 587 G + 114 B) div 1000."""
    r, g, b = channels(argb)
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def luma_shift(argb) -> Column:
    """(77 R + 150 G + 29 B) >> 8; not the same as luma_thousandths."""
    r, g, b = channels(argb)
    return F.shiftright((r * 77 + g * 150 + b * 29).cast("int"), 8)


def quantise(x) -> Column:
    """0..1 to 0..100, cut off."""
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(x))) * 100).cast("int")


def clip_region(left, top, right, bottom, w, h) -> Column:
    """Region inside the image as a struct, null if nothing is left."""
    a, b = F.greatest(c(left), F.lit(0)), F.greatest(c(top), F.lit(0))
    r, d = F.least(c(right), c(w)), F.least(c(bottom), c(h))
    return F.when((a < r) & (b < d), F.struct(a.alias("left"), b.alias("top"), r.alias("right"), d.alias("bottom")))


def _edges(points: Column) -> Column:
    return F.zip_with(points, F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))


def in_polygon(points, x, y) -> Column:
    """Whether the centre of pixel (x, y) lies inside a polygon (array of struct x, y), by crossings of a ray."""
    px, py = c(x) + 0.5, c(y) + 0.5
    crosses = lambda e: ((e.ay > py) != (e.by > py)) & (px < F.try_divide((e.bx - e.ax) * (py - e.ay), e.by - e.ay) + e.ax)
    return F.aggregate(_edges(c(points)), F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def polygon_region(points, w, h) -> Column:
    """Bounding region of a polygon, inside the image."""
    xs, ys = F.transform(c(points), lambda p: p.x), F.transform(c(points), lambda p: p.y)
    return clip_region(F.floor(F.array_min(xs)).cast("int"), F.floor(F.array_min(ys)).cast("int"), F.ceil(F.array_max(xs)).cast("int") + 1, F.ceil(F.array_max(ys)).cast("int") + 1, w, h)


def move_nearest_corner(points, x, y) -> Column:
    """The polygon with its corner nearest to (x, y), the first of equal ones, moved there."""
    new = F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    squares = F.transform(c(points), lambda p: (p.x - c(x)) * (p.x - c(x)) + (p.y - c(y)) * (p.y - c(y)))
    at = F.array_position(squares, F.array_min(squares)) - 1
    return F.transform(c(points), lambda p, i: F.when(i == at, new).otherwise(F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))))


def polygon_in_frame(points) -> Column:
    return F.forall(c(points), lambda p: p.x.between(0.0, 1.0) & p.y.between(0.0, 1.0))


def downscale(pixels, w, h, to_w: int, to_h: int) -> Column:
    """Nearest-neighbour samples of a row-major pixel array."""
    at = lambda i: F.floor(F.floor(i / to_w) * c(h) / to_h).cast("int") * c(w) + F.floor(F.pmod(i, F.lit(to_w)) * c(w) / to_w).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(to_w * to_h - 1)), lambda i: F.element_at(c(pixels), (at(i) + 1).cast("int")))
