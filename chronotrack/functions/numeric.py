"""Units, calibration, rounding, clocks, angles and coordinates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed conversion factors.
INCHES_PER_FOOT, CENTIMETRES_PER_FOOT = 12.0, 30.48
MPH_PER_FOOT_PER_SECOND = 0.6818182
MPH_PER_METRE_PER_SECOND = 2.2369362920544
FEET_PER_METRE = 3.280839895013123


def c(x) -> Column:
    """A column from a name, a column or a number."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_finite(x) -> Column:
    """True for a number, false for null, NaN and the infinities."""
    x = c(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def all_finite(*xs) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(x) for x in xs])


def first_reason(*gates: tuple[Column, str]) -> Column:
    """The reason of the first gate whose condition holds (an unknown condition doesn't), null if none does."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(gates):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return out


def half_up(x) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(c(x) + 0.5).cast("long")


def half_even(x) -> Column:
    return F.rint(c(x)).cast("long")


def half_away(x) -> Column:
    """Nearest whole number as a double, halves away from zero; a negative number that rounds to zero keeps its sign."""
    return F.signum(c(x)) * F.round(F.abs(c(x)), 0)


def tidy(x, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c(x), digits) + F.lit(0.0)


# --- units and calibration


def inches_to_feet(x) -> Column:
    return c(x) / INCHES_PER_FOOT


def centimetres_to_feet(x) -> Column:
    return c(x) / CENTIMETRES_PER_FOOT


def pixels_to_feet_per_second(speed, pixels_per_foot) -> Column:
    speed, scale = c(speed), c(pixels_per_foot)
    return F.when(is_finite(speed) & is_finite(scale) & (scale > 0), F.try_divide(speed, scale))


def feet_per_second_to_mph(x) -> Column:
    return F.when(is_finite(x), c(x) * MPH_PER_FOOT_PER_SECOND)


def metres_per_second_to_mph(x) -> Column:
    return c(x) * MPH_PER_METRE_PER_SECOND


def mph_to_metres_per_second(x) -> Column:
    return c(x) / MPH_PER_METRE_PER_SECOND


def feet_per_second_to_metres(x) -> Column:
    return c(x) / FEET_PER_METRE


def calibration_reason(pixels, feet) -> Column:
    pixels, feet = c(pixels), c(feet)
    return first_reason((~is_finite(pixels) | (pixels <= 0), "INVALID_PIXEL_DISTANCE"), (~is_finite(feet) | (feet <= 0), "INVALID_REAL_DISTANCE"))


def pixels_per_foot(pixels, feet) -> Column:
    return F.when(calibration_reason(pixels, feet).isNull(), F.try_divide(c(pixels), c(feet)))


def known_distance_scale(ax, ay, bx, by, feet) -> tuple[Column, Column]:
    """Pixels per foot from two image points a known distance apart, and the reason why there is none."""
    distance = F.hypot(c(bx) - c(ax), c(by) - c(ay))
    points = all_finite(ax, ay, bx, by)
    reason = F.when(~points, "INVALID_POINT").otherwise(calibration_reason(distance, feet))
    return F.when(points, pixels_per_foot(distance, feet)), reason


def depth_scale(scale, ball_depth, plane_depth, least: float = 0.1, most: float = 10.0) -> tuple[Column, Column]:
    """Scale corrected for the ball's plane, and the reason why there is none."""
    s, b, p = c(scale), c(ball_depth), c(plane_depth)
    usable = is_finite(s) & is_finite(b) & is_finite(p) & (s > 0) & (b > 0) & (p > 0)
    factor = F.try_divide(p, b)
    good = usable & factor.between(least, most)
    return F.when(good, s * factor), F.when(~good, "BAD_CALIBRATION")


def depth_warning(ball_depth, plane_depth) -> Column:
    """Whether the correction is far from 1."""
    factor = F.try_divide(c(plane_depth), c(ball_depth))
    return (factor < 0.5) | (factor > 2.0)


# --- angles


def normalise_signed_degrees(x) -> Column:
    """Into (-180, 180]; what is nearly zero becomes zero."""
    v = F.lit(180.0) - F.pmod(F.lit(180.0) - c(x), F.lit(360.0))
    return F.when(F.abs(v) < 1e-9, F.lit(0.0)).otherwise(v)


def correct_for_roll(angle, roll) -> Column:
    return F.when(c(roll).isNull(), c(angle)).otherwise(normalise_signed_degrees(c(angle) - c(roll)))


def normalise_degrees(x) -> Column:
    return F.pmod(c(x), F.lit(360))


def right_angle(x) -> Column:
    """0, 90, 180 or 270, or null for any other rotation."""
    v = normalise_degrees(x)
    return F.when(F.pmod(v, F.lit(90)) == 0, v)


def launch_angle(vx, vy) -> Column:
    """Degrees above the horizontal of a velocity in image coordinates (y points down)."""
    return F.degrees(F.atan2(-c(vy), F.abs(c(vx))))


def circular_distance(a, b) -> Column:
    d = F.abs(normalise_hue(a) - normalise_hue(b))
    return F.least(d, F.lit(360.0) - d)


def normalise_hue(x) -> Column:
    return F.pmod(c(x), F.lit(360.0))


# --- clocks


def expected_gap_ns(fps) -> Column:
    return half_up(F.lit(1e9) / c(fps))


def sample_to_elapsed_ns(sample, anchor_sample, anchor_ns, rate) -> Column:
    """Clock time of an audio sample, null before the anchor."""
    d = c(sample) - c(anchor_sample)
    return F.when(d >= 0, c(anchor_ns) + F.expr("1000000000L") * d.cast("long") / c(rate)).cast("long")


def elapsed_ns_to_sample(ns, anchor_sample, anchor_ns, rate, max_age_ns) -> Column:
    """Sample at a clock time, null before the anchor or when the anchor is too old."""
    d = c(ns) - c(anchor_ns)
    return F.when((d >= 0) & (d <= c(max_age_ns)), c(anchor_sample) + F.floor(d.cast("double") * c(rate) / 1e9).cast("long"))


def shift_range(frames, sensors) -> Column:
    """Whole-frame shifts to try: one either way for counts that differ by one at most, else the mismatch and two more."""
    d = F.abs(c(frames) - c(sensors))
    n = F.when(d <= 1, F.lit(1)).otherwise(d + 2).cast("int")
    return F.sequence(-n, n)


def burst_ms(x, default: int = 2500, most: int = 8000) -> Column:
    """Burst duration: the default for none, at most ``most``."""
    return F.when(c(x) <= 0, F.lit(default)).otherwise(F.least(c(x), F.lit(most)))


def backoff_ms(errors, base: int = 350, cap: int = 2800) -> Column:
    """base, doubled with each further error, up to cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2), F.least(F.greatest(c(errors), F.lit(1)), F.lit(20)) - 1).cast("long"), F.lit(cap)).cast("long")


def frame_cap(fps, ms, least: int = 1, most: int = 240) -> Column:
    return F.least(F.greatest(F.ceil(c(fps) * c(ms) / 1000.0).cast("long"), F.lit(least)), F.lit(most))


def sample_budget(duration_s, fps) -> Column:
    """Samples that a decode may visit: ceil(s * fps) + max(fps, 30)."""
    return F.ceil(c(duration_s) * c(fps)).cast("long") + F.greatest(c(fps), F.lit(30))


def impact_window(offset_us, fps, error_ns, before_us: int = 1_000_000, after_us: int = 1_000_000, max_margin: int = 12):
    """(first us, last us, frame, margin frames) of the container window around an impact."""
    gap = F.lit(1e9) / c(fps)
    margin = F.least(F.ceil(c(error_ns) / gap).cast("long"), F.lit(max_margin).cast("long"))
    return F.greatest(c(offset_us) - before_us, F.lit(0)), c(offset_us) + after_us, F.floor(c(offset_us) * c(fps) / 1e6).cast("long"), margin


# --- coordinates


def view_scale(view_w, view_h, src_w, src_h, mode: str = "fit") -> tuple[Column, Column]:
    """Scale in x and y of a source shown in a view: fit keeps all of it, crop fills the view, stretch does both."""
    sx, sy = c(view_w) / c(src_w), c(view_h) / c(src_h)
    if mode == "stretch":
        return sx, sy
    s = F.least(sx, sy) if mode == "fit" else F.greatest(sx, sy)
    return s, s


def view_to_normalised(x, y, view_w, view_h, src_w, src_h, mode: str = "fit") -> tuple[Column, Column]:
    """Normalised source point under a view point, null outside the source."""
    sx, sy = view_scale(view_w, view_h, src_w, src_h, mode)
    w, h = c(src_w) * sx, c(src_h) * sy
    nx, ny = (c(x) - (c(view_w) - w) / 2.0) / w, (c(y) - (c(view_h) - h) / 2.0) / h
    inside = in_frame(nx, ny)
    return F.when(inside, nx), F.when(inside, ny)


def normalised_to_view(nx, ny, view_w, view_h, src_w, src_h, mode: str = "fit") -> tuple[Column, Column]:
    sx, sy = view_scale(view_w, view_h, src_w, src_h, mode)
    w, h = c(src_w) * sx, c(src_h) * sy
    return (c(view_w) - w) / 2.0 + c(nx) * w, (c(view_h) - h) / 2.0 + c(ny) * h


def rotate_normalised(x, y, degrees) -> tuple[Column, Column]:
    """A normalised point after a turn by 0, 90, 180 or 270 degrees clockwise; null for other turns."""
    x, y, d = c(x), c(y), normalise_degrees(degrees)
    rx = F.when(d == 0, x).when(d == 90, F.lit(1.0) - y).when(d == 180, F.lit(1.0) - x).when(d == 270, y)
    ry = F.when(d == 0, y).when(d == 90, x).when(d == 180, F.lit(1.0) - y).when(d == 270, F.lit(1.0) - x)
    return rx, ry


def normalised_to_pixel(n, size) -> Column:
    """Pixel of a normalised coordinate, clamped into the image."""
    return F.least(F.greatest(F.floor(c(n) * c(size)).cast("long"), F.lit(0)), c(size) - 1)


def in_frame(*xs) -> Column:
    return reduce(lambda a, b: a & b, [c(x).between(0.0, 1.0) for x in xs])


def scale_float(x, from_size, to_size) -> Column:
    """Coordinate in another image size, in 32-bit floating point."""
    return (c(x).cast("float") * (c(to_size).cast("float") / c(from_size).cast("float")).cast("float")).cast("float")


def working_size(w, h, max_w: int = 640, max_h: int = 360) -> tuple[Column, Column]:
    """Size within the cap that keeps the aspect (never larger than the source), halves to even."""
    s = F.least(F.lit(1.0), F.lit(float(max_w)) / c(w), F.lit(float(max_h)) / c(h))
    return F.greatest(half_even(c(w) * s), F.lit(1)), F.greatest(half_even(c(h) * s), F.lit(1))


def scaled_area(area, w, h, work_w, work_h) -> Column:
    return F.greatest(half_even(c(area) * (c(work_w) * c(work_h)) / (c(w) * c(h))), F.lit(1))


def padded_range(first, last, frames, pad: int = 10, least: int = 32) -> tuple[Column, Column]:
    """[first - pad, last + pad] inside the clip, then grown by turns, left first, to ``least`` frames where the clip has them."""
    top = c(frames) - 1
    a, b = F.greatest(c(first) - pad, F.lit(0)), F.least(c(last) + pad, top)
    missing = F.greatest(F.least(F.lit(least), c(frames)) - (b - a + 1), F.lit(0))
    left = F.least(a, F.ceil(missing / 2.0).cast("int"))
    right = F.least(top - b, missing - left)
    left = F.least(a, missing - right)
    return a - left, b + right


def even_positions(n, k) -> Column:
    """k of n positions, evenly spread with the first and the last, without repeats."""
    n, k = c(n).cast("int"), c(k).cast("int")
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: half_up(i * (n - 1) / F.greatest(k - 1, F.lit(1)))))
    return F.when((n <= 0) | (k <= 0), F.array().cast("array<bigint>")).when(k >= n, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("long"))).when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(many)


def interior_positions(n) -> Column:
    """All interior positions if there are three at most, else three, evenly spread."""
    n = c(n).cast("int")
    three = F.array_distinct(F.array(*[(F.lit(1) + F.floor((n - 3) * q / 4)).cast("int") for q in (1, 2, 3)]))
    return F.when(n <= 2, F.array().cast("array<int>")).when(n <= 5, F.sequence(F.lit(1), n - 2)).otherwise(three)
