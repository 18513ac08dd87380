"""Estimates of speed and angle per track, with ordered gates and explicit confidence."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.numeric import correct_for_roll, depth_scale, depth_warning, first_reason, is_finite, pixels_per_foot
from chronotrack.operators.fit import measurement, velocity_fit
from chronotrack.operators.timing import frame_delta_times

LEAST = 4
STILL_PX, PROGRESS_PX, RATIO_SLACK = 1.0, 1e-6, 0.5


@dataclass(frozen=True)
class EstimateConfig:
    """Gates of an estimate; the defaults are those of the library profile."""

    max_rms: float = 2.0
    max_rms_diameters: float | None = None
    min_spread: float = 1e-6
    passes: int = 1
    min_gain: float = 0.5
    gap_ratio: float = 2.5
    ratio_error: float = 0.35
    max_rejected: int = 1
    size_ratio: float = 1.5
    allow_size_change: bool = False
    ball_feet: float | None = None
    ball_samples: int = 3
    progression: bool = True
    min_mph: float | None = None
    speed_gate: str = "ALL_TRUSTED_SCALE"
    ball_depth: float | None = None
    plane_depth: float | None = None
    roll: float | None = None

    def check(self) -> None:
        positive = lambda x: math.isfinite(x) and x > 0
        rules = (
            positive(self.max_rms), self.max_rms_diameters is None or positive(self.max_rms_diameters), positive(self.min_spread), self.passes >= 0 and self.max_rejected >= 0,
            math.isfinite(self.min_gain) and self.min_gain >= 0, math.isfinite(self.gap_ratio) and self.gap_ratio > 1, math.isfinite(self.ratio_error) and self.ratio_error >= 0,
            math.isfinite(self.size_ratio) and self.size_ratio > 1, self.ball_feet is None or positive(self.ball_feet), self.ball_samples >= 1,
            self.min_mph is None or (math.isfinite(self.min_mph) and self.min_mph >= 0), self.speed_gate in ("DISABLED", "SAME_PLANE_ONLY", "ALL_TRUSTED_SCALE"),
            (self.ball_depth is None) == (self.plane_depth is None),
        )
        if not all(rules):
            raise ValueError("NON_FINITE_RESULT: an estimate gate is out of its range")


#: Profile of recorded clips.
RECORDED = EstimateConfig(max_rms=8.0, max_rms_diameters=0.35, passes=0, allow_size_change=True, progression=False, speed_gate="DISABLED")


def trim_stationary(df: DataFrame, key: str, order: str, x: str, y: str, still: float = STILL_PX) -> DataFrame:
    """Tracks without their still beginning: if the second row hasn't moved, rows before the first move go, if LEAST stay."""
    w, whole = W.partitionBy(key).orderBy(order), W.partitionBy(key)
    df = df.withColumn("__rn", F.row_number().over(w))
    d = F.hypot(F.col(x) - F.first(x).over(w), F.col(y) - F.first(y).over(w))
    df = df.withColumn("__d", d)
    df = df.withColumns({"__move": F.min(F.when(F.col("__d") >= still, F.col("__rn"))).over(whole), "__n": F.count(F.lit(1)).over(whole)})
    cut = (F.col("__n") >= LEAST) & (F.col("__move") > 2) & (F.col("__n") - F.col("__move") + 1 >= LEAST)
    return df.where(~F.coalesce(cut, F.lit(False)) | (F.col("__rn") >= F.col("__move"))).drop("__rn", "__d", "__move", "__n")


def interval_coherence(df: DataFrame, key: str, order: str, t: str, x: str, y: str, gap_ratio: float, error: float) -> DataFrame:
    """PLAIN where gaps are even, COALESCED where uneven gaps agree with displacements, else INCOHERENT; and the gap figures."""
    w = W.partitionBy(key).orderBy(order)
    g = df.withColumns({"__g": F.col(t) - F.lag(t).over(w), "__d": F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))}).where("__g is not null")
    m = g.groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), F.min("__g").alias("min_gap"), F.median("__g").alias("median_gap"), F.max("__g").alias("max_gap"), F.median("__d").alias("__md"))
    tr, dr = F.try_divide(F.col("__g"), F.col("median_gap")), F.try_divide(F.col("__d"), F.col("__md"))
    agree = g.join(m, key).groupBy(key).agg(F.bool_and(F.abs(tr - dr) <= F.greatest(F.lit(RATIO_SLACK), tr * error)).alias("__agree"))
    out = m.join(agree, key).withColumn("gap_ratio", F.try_divide(F.col("max_gap"), F.col("median_gap")))
    kind = F.when(F.col("gap_ratio") <= gap_ratio, "PLAIN").when((F.col("__md") > 0) & F.col("__agree"), "COALESCED").otherwise("INCOHERENT")
    return out.select(key, "gaps", "min_gap", "median_gap", "max_gap", "gap_ratio", kind.alias("coherence"))


def size_change(df: DataFrame, key: str, diameter: str) -> DataFrame:
    """Number of sizes, whether all are finite and positive, their median and the ratio of the largest to the smallest."""
    d, ok = F.col(diameter), is_finite(diameter) & (F.col(diameter) > 0)
    return df.groupBy(key).agg(
        F.count(d).alias("sizes"), F.coalesce(F.bool_and(F.when(d.isNotNull(), ok)), F.lit(True)).alias("sizes_ok"), F.median(F.when(ok, d)).alias("median_size"),
        F.when(F.count(d) >= 2, F.try_divide(F.max(F.when(ok, d)), F.min(F.when(ok, d)))).alias("size_ratio"),
    )


def progression(df: DataFrame, fit: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Whether the used rows never go back along the fitted direction and end ahead."""
    w = W.partitionBy(key).orderBy(order)
    j = df.join(fit.select(key, "used", "vx", "vy", "speed"), key).where(F.array_contains("used", F.col(order)))
    p = j.withColumn("__p", F.try_divide(F.col(x) * F.col("vx") + F.col(y) * F.col("vy"), F.col("speed")))
    p = p.withColumn("__up", F.col("__p") + PROGRESS_PX >= F.lag("__p").over(w))
    g = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and("__up").alias("up"), F.min_by("__p", order).alias("a"), F.max_by("__p", order).alias("b"))
    return g.select(key, ((F.col("n") >= LEAST) & F.coalesce(F.col("up"), F.lit(False)) & (F.col("b") > F.col("a"))).alias("progresses"))


def direction_reversal(df: DataFrame, key: str, order: str, x: str, least: float) -> DataFrame:
    """Whether any step of ``least`` or more goes against the whole track's direction."""
    w = W.partitionBy(key).orderBy(order)
    s = df.withColumn("__dx", F.col(x) - F.lag(x).over(w))
    total = s.groupBy(key).agg((F.max_by(x, order) - F.min_by(x, order)).alias("total"))
    against = (F.abs(F.col("__dx")) >= least) & (F.signum("__dx") == -F.signum("total")) & (F.col("total") != 0)
    return s.join(total, key).groupBy(key).agg(F.coalesce(F.bool_or(against), F.lit(False)).alias("reverses"))


def confidence(n, gap_ratio, rms, max_rms, coherence, depth_corrected) -> Column:
    even = (n >= 6) & (gap_ratio <= 1.25) & (rms <= max_rms * 0.5)
    return F.when(coherence == "COALESCED", "LOW").when(even & depth_corrected, "MEDIUM").when(even, "HIGH").when((n >= 5) & (gap_ratio <= 1.75) & (rms <= max_rms * 0.75), "MEDIUM").otherwise("LOW")


def assumptions(inferred: bool, basis: Column, level: bool) -> Column:
    """Disclosures that go with an estimate."""
    has = lambda c, s: F.when(c, F.lit(s))
    return F.array_compact(
        F.array(
            F.lit("planar motion"), F.lit("static level reference" if level else "no level reference"), F.when(F.lit(inferred), F.lit("timing inferred from displacement")),
            has(basis == "BALL_DIAMETER_SELF_CALIBRATION", "scale from ball diameter"), has(basis == "DEPTH_CORRECTED_DISTANCE_CALIBRATION", "scale corrected for depth"), has(basis == "DEPTH_CORRECTED_DISTANCE_CALIBRATION", "motion in depth not measured"),
        )
    )


def estimate(samples: DataFrame, key: str, order: str, t: str, x: str, y: str, diameter: str | None, calibration: DataFrame, pixels: str, feet: str, config: EstimateConfig | None = None, frame_interval: float | None = None) -> DataFrame:
    """One row per track: status and reason, or mph, angle, rms, confidence, basis, warnings and assumptions.

    ``calibration``: one row per track (key, pixels, feet; null where unknown). With ``frame_interval`` times are inferred
    from displacements. Gates apply in a fixed order; a track that fails one has no values.
    """
    config = config or EstimateConfig()
    config.check()
    inferred = frame_interval is not None
    size = F.col(diameter).cast("double") if diameter else F.lit(None).cast("double")
    df = samples.select(key, order, F.col(t).cast("double").alias("t") if t else F.lit(0.0).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"), size.alias("size"))
    df = trim_stationary(df, key, order, "x", "y")
    if inferred:
        df = frame_delta_times(df, key, order, "x", "y", F.lit(frame_interval)).select(key, order, "t", "x", "y", "size", "unit")
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), (F.max(F.col("unit").isNotNull()) if inferred else F.lit(True)).alias("moved"))
    co, sizes = interval_coherence(df, key, order, "t", "x", "y", config.gap_ratio, config.ratio_error), size_change(df, key, "size")
    up = df.withColumn("__g", F.col("t") - F.lag("t").over(W.partitionBy(key).orderBy(order))).groupBy(key).agg(F.bool_and(is_finite("t") & F.coalesce(F.col("__g") > 0, F.lit(True))).alias("timed"))
    cal = calibration.select(key, F.col(pixels).cast("double").alias("pixels"), F.col(feet).cast("double").alias("feet"))
    base = n.join(cal, key, "left").join(co, key, "left").join(sizes, key).join(up, key)
    own = pixels_per_foot("pixels", "feet")
    complete = F.col("pixels").isNotNull() & F.col("feet").isNotNull()
    if config.ball_depth is not None:
        scale, basis = depth_scale(own, F.lit(config.ball_depth), F.lit(config.plane_depth))[0], F.lit("DEPTH_CORRECTED_DISTANCE_CALIBRATION")
    elif config.ball_feet is not None:
        ball = F.when((F.col("sizes") >= config.ball_samples) & F.col("sizes_ok"), F.col("median_size") / config.ball_feet)
        scale, basis = F.when(complete, own).otherwise(ball), F.when(complete, "DISTANCE_CALIBRATION").otherwise("BALL_DIAMETER_SELF_CALIBRATION")
    else:
        scale, basis = own, F.lit("DISTANCE_CALIBRATION")
    limit = F.lit(config.max_rms)
    if config.max_rms_diameters is not None:
        limit = F.greatest(limit, F.coalesce(F.col("median_size") * config.max_rms_diameters, F.lit(0.0)))
    base = base.withColumns({"scale": scale, "basis": basis, "limit": limit})
    fit = velocity_fit(df, key, order, "t", "x", "y", config.min_spread, config.passes, config.min_gain)
    m = measurement(fit.join(base, key), "scale", float("inf"))
    m = m.join(progression(df, fit, key, order, "x", "y"), key, "left")
    fit_reason = F.when(F.col("reason") == "INSUFFICIENT_DETECTIONS", F.col("reason")).when(F.col("reason").isin("BAD_TIMESTAMP", "INVALID_DETECTION"), "BAD_TIMESTAMPS").when(F.col("reason") == "INVALID_CALIBRATION", "BAD_CALIBRATION").when(F.col("reason").isNotNull(), "NON_FINITE_RESULT")
    grown = (F.col("size_ratio") > config.size_ratio) & F.lit(not config.allow_size_change)
    gate = {"DISABLED": F.lit(False), "SAME_PLANE_ONLY": F.col("basis") == "DISTANCE_CALIBRATION", "ALL_TRUSTED_SCALE": F.col("basis") != "DEPTH_CORRECTED_DISTANCE_CALIBRATION"}[config.speed_gate]
    rejected = F.col("frames") - F.col("used_count")
    before = first_reason(
        (F.lit(not inferred) & (~F.col("timed") | (F.col("frames") < 2)), "BAD_TIMESTAMPS"), (F.col("frames") < LEAST, "INSUFFICIENT_DETECTIONS"), (~F.col("moved"), "AMBIGUOUS_TRACK"), (F.col("scale").isNull(), "BAD_CALIBRATION"),
        (F.lit(not inferred) & (F.col("coherence") == "INCOHERENT"), "AMBIGUOUS_TRACK"), (~F.col("sizes_ok"), "DETECTION_FAILED"), (grown, "PLANAR_ASSUMPTION_VIOLATED"),
    )
    after = first_reason(
        (F.col("rms") > F.col("limit"), "EXCESSIVE_RESIDUAL"), (F.col("used_count") < LEAST, "INSUFFICIENT_DETECTIONS"), (rejected > config.max_rejected, "AMBIGUOUS_TRACK"),
        (F.lit(config.progression) & ~F.coalesce(F.col("progresses"), F.lit(False)), "AMBIGUOUS_TRACK"), (gate & (F.col("mph") < F.lit(config.min_mph if config.min_mph is not None else -1.0)), "AMBIGUOUS_TRACK"),
    )
    kind = F.lit("COALESCED") if inferred else F.col("coherence")
    depth = F.lit(config.ball_depth is not None)
    w = F.array_compact(F.array(
        F.when(rejected == 1, F.lit("one outlier rejected")), F.when(F.lit(inferred), F.lit("frame intervals inferred")), F.when(kind == "COALESCED", F.lit("skipped intervals supported by displacement")),
        F.when(F.col("size_ratio") > config.size_ratio, F.lit("apparent size varied")), F.when(depth, F.lit("depths entered by user")), F.when(depth & depth_warning(F.lit(config.ball_depth), F.lit(config.plane_depth)) if config.ball_depth else F.lit(False), F.lit("depth correction far from same plane")),
        F.when(~gate & F.lit(config.min_mph is not None), F.lit("speed gate skipped")),
    ))
    out = m.withColumn("why", F.coalesce(before, fit_reason, after))
    ok = F.col("why").isNull()
    return out.select(
        key, F.when(ok, "OK").otherwise("NO_READ").alias("status"), F.col("why").alias("reason"), F.col("frames").alias("frame_count"), F.when(ok, F.col("used_count")).alias("detection_count"),
        F.when(ok, F.col("mph")).alias("mph"), F.when(ok, correct_for_roll("angle", F.lit(config.roll).cast("double"))).alias("angle"), F.when(ok, F.col("rms")).alias("rms"),
        F.when(ok, confidence(F.col("frames"), F.col("gap_ratio"), F.col("rms"), F.col("limit"), kind, depth)).alias("confidence"), F.when(ok, F.col("basis")).alias("basis"), F.when(ok, w).alias("warnings"), F.when(ok, assumptions(inferred, F.col("basis"), config.roll is not None)).alias("assumptions"),
    )


def strict_measurement(samples: DataFrame, key: str, order: str, t: str, x: str, y: str, scale: Column | str, max_rms: float = 2.0, passes: int = 1, min_gain: float = 0.5) -> DataFrame:
    """Fit, speed and angle with proven times."""
    fit = velocity_fit(samples, key, order, t, x, y, 1e-6, passes, min_gain)
    extra = [c for c in samples.columns if c == scale]
    if extra:
        fit = fit.join(samples.groupBy(key).agg(F.max(scale).alias(scale)), key)
    return measurement(fit, scale, max_rms)
