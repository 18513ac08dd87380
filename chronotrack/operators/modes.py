"""Camera modes, readiness and honesty contracts of results, reason tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrack.functions.colour import channels, hsv, pack
from chronotrack.functions.numeric import first_reason, is_finite

# Supported sizes and rates.
SIZES, RATES = ((1280, 720), (1920, 1080)), (120, 240)
#: Planned proof variants: id, session shape, consumer, constrained, surfaces in order, needs a scratch file.
VARIANTS = (
    ("companion-gl", "COMPANION_ENCODER", "SINGLE_SURFACE_TEXTURE", True, "COMPANION_ENCODER,DIRECT_GL_READBACK", True),
    ("direct-gl-first", "COMPANION_ENCODER_REVERSED", "SINGLE_SURFACE_TEXTURE", True, "DIRECT_GL_READBACK,COMPANION_ENCODER", True),
    ("pbo-gl-readback", "COMPANION_ENCODER_REVERSED", "PBO_GL_READBACK", True, "DIRECT_GL_READBACK,COMPANION_ENCODER", True),
    ("direct-gl-only", "DIRECT_ONLY", "SINGLE_SURFACE_TEXTURE", True, "DIRECT_GL_READBACK", False),
    ("constrained-image-reader", "CONSTRAINED_IMAGE_READER", "CONSTRAINED_IMAGE_READER", True, "IMAGE_READER", False),
    ("constrained-private-image-reader", "CONSTRAINED_PRIVATE_IMAGE_READER", "CONSTRAINED_PRIVATE_IMAGE_READER", True, "IMAGE_READER", False),
    ("standard-image-reader", "STANDARD_IMAGE_READER", "STANDARD_IMAGE_READER", False, "IMAGE_READER", False),
)
#: Failures of a fit as reasons of an estimate.
ESTIMATE_REASONS = {
    "INSUFFICIENT_DETECTIONS": "INSUFFICIENT_DETECTIONS", "BAD_TIMESTAMP": "BAD_TIMESTAMPS", "INVALID_DETECTION": "BAD_TIMESTAMPS", "INVALID_OPTIONS": "BAD_TIMESTAMPS", "INVALID_CALIBRATION": "BAD_CALIBRATION",
    "NON_FINITE_FIT": "NON_FINITE_RESULT", "EXCESSIVE_RESIDUAL": "EXCESSIVE_RESIDUAL",
}
#: Mapping failures, the most specific first.
MAPPING_PRECEDENCE = ("RESIDUAL_TOO_LARGE", "SYNTHETIC_UNIFORM_PTS", "DROPPED_HOLE_MISMATCH", "MANY_TO_ONE_MAPPING", "NON_MONOTONIC_MAPPING", "INSUFFICIENT_MATCHED_FRAMES")


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VARIANTS), "id string, shape string, consumer string, constrained boolean, surfaces string, needs_scratch boolean")


def flatten_ranges(cameras: DataFrame, key: str, sizes: str, ranges: str) -> DataFrame:
    """One row for each size and rate range of a camera (arrays of struct w, h and low, high)."""
    return cameras.select(key, F.explode(sizes).alias("s"), ranges).select(key, "s.*", F.explode(ranges).alias("r")).select(key, "w", "h", "r.*")


def map_modes(ranges: DataFrame, keys: list[str], sizes=SIZES, rates=RATES) -> DataFrame:
    """A mode for each supported size and rate: its fixed range, else the one with the nearest lower bound, the first of equal ones (``seq``)."""
    known = F.lit(False)
    for w, h in sizes:
        known = known | ((F.col("w") == w) & (F.col("h") == h))
    r = ranges.where(known & F.col("high").isin(*rates))
    pick = F.min_by(F.col("low"), F.struct((F.col("low") != F.col("high")).cast("int"), F.abs(F.col("low") - F.col("high")), "seq"))
    m = r.groupBy(*keys, "w", "h", F.col("high").alias("fps")).agg(pick.alias("low"))
    return m.withColumn("recordable", F.col("low") == F.col("fps")).withColumn("rank", mode_rank(sizes, rates))


def mode_rank(sizes=SIZES, rates=RATES) -> Column:
    """Recordable known modes first, the slower rate and the smaller size before, then other recordable ones."""
    out, k = F.when(F.col("recordable"), len(sizes) * len(rates)).otherwise(len(sizes) * len(rates) + 1), 0
    for fps in rates:
        for w, h in sizes:
            out = F.when(F.col("recordable") & (F.col("w") == w) & (F.col("h") == h) & (F.col("fps") == fps), k).otherwise(out)
            k += 1
    return out


def default_mode(modes: DataFrame, key: str, fps: int = 120) -> DataFrame:
    m = modes.where(F.col("recordable") & (F.col("fps") == fps))
    return m.groupBy(key).agg(F.min_by(F.struct("w", "h", "fps", "low"), F.struct("rank", F.col("w") * F.col("h"))).alias("m")).select(key, "m.*")


def start_reason(requests: DataFrame, modes: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """CAPTURE_BUSY unless idle, UNSUPPORTED_MODE unless the very mode is known, at 120 with a fixed range."""
    known = modes.where((F.col("fps") == 120) & F.col("recordable")).select(*keys, "w", "h", "fps", "low").distinct().withColumn("__known", F.lit(True))
    j = requests.join(known, [*keys, "w", "h", "fps", "low"], "left")
    return j.withColumn("reason", first_reason((F.col(state) != "IDLE", "CAPTURE_BUSY"), (F.col("__known").isNull(), "UNSUPPORTED_MODE"))).drop("__known")


def variant_reason(shape: Column, constrained: Column, surfaces: Column) -> Column:
    """Whether a session shape goes with its surfaces: one or two, an encoder only in companion shapes, never both readers."""
    n = F.size(F.split(surfaces, ","))
    companion = surfaces.contains("COMPANION_ENCODER")
    return first_reason((n > 2, "TOO_MANY_SURFACES"), (companion != shape.startswith("COMPANION"), "SHAPE_MISMATCH"), (companion & ~constrained, "UNCONSTRAINED_COMPANION"))


def readiness(permission: Column, geometry: Column, scale: Column, level: Column, colour: Column) -> Column:
    """First prerequisite that is missing, null if the capture can be armed."""
    return first_reason((~permission, "PERMISSION"), (~geometry, "GEOMETRY"), (~scale, "SCALE"), (~level, "LEVEL"), (~colour, "COLOUR"))


def colour_readiness(w: Column, h: Column, hue: Column, saturation: Column, value: Column, region_left: Column, region_right: Column) -> Column:
    valid = hue.between(0, 360) & saturation.between(0, 1) & value.between(0, 1)
    return first_reason(((w <= 0) | (h <= 0), "NO_FRAME"), (hue.isNull(), "NO_SAMPLE"), (~valid, "INVALID_SAMPLE"), ((region_left >= w) | (region_right <= 0) | (region_left >= region_right), "REGION_OUTSIDE"))


def nominal_cadence_reason() -> Column:
    """Counts times a rate are never accepted as measured times."""
    return F.lit("UNPROVEN_TIMESTAMPS")


def success_reason(mph, angle, height_ft, frames, detections, median_gap, max_gap, residual, confidence, assumptions, timing, basis) -> Column:
    """Why a result must not be shown as a success, in order; null if it may."""
    discloses = lambda word: F.exists(assumptions, lambda a: F.lower(a).contains(word))
    bad_angle = angle.isNotNull() & ~is_finite(angle)
    return first_reason(
        (~is_finite(mph) | (mph < 0) | bad_angle | ~is_finite(height_ft) | (height_ft < 0), "NON_FINITE_RESULT"),
        ((frames < 1) | (detections < 1), "INSUFFICIENT_DETECTIONS"),
        (~is_finite(median_gap) | ~is_finite(max_gap) | (median_gap <= 0), "BAD_TIMESTAMPS"),
        (~is_finite(residual) | (residual < 0), "EXCESSIVE_RESIDUAL"),
        (confidence.isNull(), "AMBIGUOUS_TRACK"),
        (~discloses("calibrated image plane"), "PLANAR_ASSUMPTION_VIOLATED"),
        ((timing == "VISUAL_FRAME_DELTA_INFERENCE") & ~discloses("smallest observed frame gap"), "BAD_TIMESTAMPS"),
        ((basis == "BALL_DIAMETER_SELF_CALIBRATION") & ~discloses("entered ball diameter"), "BAD_CALIBRATION"),
        ((basis == "DEPTH_CORRECTED_DISTANCE_CALIBRATION") & ~discloses("depth-corrected scale"), "BAD_CALIBRATION"),
        (detections > frames, "AMBIGUOUS_TRACK"),
    )


def translate(reason: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for a, b in table.items():
        out = F.when(reason == a, b).otherwise(out)
    return F.when(reason.isNotNull(), out)


def most_specific(reason: Column) -> Column:
    """Aggregate: the first of MAPPING_PRECEDENCE among a group's reasons."""
    rank = F.lit(len(MAPPING_PRECEDENCE))
    for k, r in reversed(list(enumerate(MAPPING_PRECEDENCE))):
        rank = F.when(reason == r, k).otherwise(rank)
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in MAPPING_PRECEDENCE]), F.min(rank)), F.lit("NO_CANDIDATE"))


def patch_colour(pixels: DataFrame, keys: list[str], x, y, w: int, h: int, radius: int = 4) -> DataFrame:
    """Hue, saturation and value of the mean colour in a clipped square around a normalised point (rows px, py, argb)."""
    at = lambda v, n: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1))
    near = (F.abs(F.col("px") - at(x, w)) <= radius) & (F.abs(F.col("py") - at(y, h)) <= radius)
    r, g, b = channels("argb")
    mean = lambda v: F.floor(F.avg(v)).cast("int")
    m = pixels.where(near).groupBy(*keys).agg(mean(r).alias("r"), mean(g).alias("g"), mean(b).alias("b"))
    hue, s, v = hsv(pack(F.lit(255), "r", "g", "b"))
    return m.select(*keys, hue.alias("hue"), s.alias("saturation"), v.alias("value"))
