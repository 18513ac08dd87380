"""Straight-line velocity fits with outlier rejection, speed and angle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.numeric import all_finite, c, feet_per_second_to_mph, first_reason, is_finite, launch_angle, pixels_to_feet_per_second

LEAST = 3
TIE = 1e-12


def check_options(min_spread: float, passes: int, min_gain: float, max_rms: float | None = None) -> None:
    """Options are the caller's constants: wrong ones raise before any plan is built."""
    import math

    if not (math.isfinite(min_spread) and min_spread > 0):
        raise ValueError("INVALID_OPTIONS: the least time spread must be finite and positive")
    if passes < 0:
        raise ValueError("INVALID_OPTIONS: the number of outlier passes must not be negative")
    if not (math.isfinite(min_gain) and min_gain >= 0):
        raise ValueError("INVALID_OPTIONS: the least gain must be finite and not negative")
    if max_rms is not None and not (math.isfinite(max_rms) and max_rms > 0):
        raise ValueError("INVALID_OPTIONS: the largest residual must be finite and positive")


def detection_reason(df: DataFrame, key: str, order: str, t: str, x: str, y: str) -> DataFrame:
    """Why a track can't be fitted, in order of precedence, null if it can."""
    w = W.partitionBy(key).orderBy(order)
    g = df.withColumns({"__ok": all_finite(t, x, y), "__up": F.col(t) > F.lag(t).over(w)}).groupBy(key)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.bool_and("__ok").alias("ok"), F.bool_and("__up").alias("up"))
    return out.select(key, "n", first_reason((F.col("n") < LEAST, "INSUFFICIENT_DETECTIONS"), (~F.col("ok"), "INVALID_DETECTION"), (~F.col("up"), "BAD_TIMESTAMP")).alias("reason"))


def _moments(df: DataFrame, key: str, t: str, x: str, y: str) -> DataFrame:
    """Rows with the sums of their track, times and places counted from its means, so that large epochs keep their digits."""
    w = W.partitionBy(key)
    df = df.withColumns({"__mt": F.avg(t).over(w), "__mx": F.avg(x).over(w), "__my": F.avg(y).over(w)})
    df = df.withColumns({"__t": F.col(t) - F.col("__mt"), "__x": F.col(x) - F.col("__mx"), "__y": F.col(y) - F.col("__my")})
    s = lambda e: F.sum(e).over(w)
    T, X, Y = F.col("__t"), F.col("__x"), F.col("__y")
    return df.withColumns({"__n": F.count(F.lit(1)).over(w), "__tt": s(T * T), "__tx": s(T * X), "__ty": s(T * Y), "__xx": s(X * X), "__yy": s(Y * Y)})


def _leave_one_out(df: DataFrame, key: str, order: str, t: str, x: str, y: str, spread: float, gain: float) -> DataFrame:
    """One pass: drop the row without which the residual shrinks most, if by ``gain`` and if LEAST rows stay.

    The sums of a track without one row have a closed form, so all candidate fits of all tracks are one window pass.
    """
    m = _moments(df, key, t, x, y)
    n, k = F.col("__n"), F.try_divide(F.col("__n"), F.col("__n") - 1)
    tt = F.col("__tt") - k * F.col("__t") * F.col("__t")
    left = lambda sxx, stx, v: sxx - k * v * v - F.try_divide((stx - k * F.col("__t") * v) * (stx - k * F.col("__t") * v), tt)
    now = F.col("__xx") + F.col("__yy") - F.try_divide(F.col("__tx") * F.col("__tx") + F.col("__ty") * F.col("__ty"), F.col("__tt"))
    without = left(F.col("__xx"), F.col("__tx"), F.col("__x")) + left(F.col("__yy"), F.col("__ty"), F.col("__y"))
    better = F.sqrt(F.greatest(now, F.lit(0.0)) / n) - F.sqrt(F.greatest(without, F.lit(0.0)) / (n - 1))
    m = m.withColumn("__gain", F.when((n > LEAST) & (tt > spread) & (better >= gain), better))
    top = F.max("__gain").over(W.partitionBy(key))
    # Of gains within TIE of the best, the first row goes.
    m = m.withColumn("__first", F.min(F.when(F.col("__gain") >= top - TIE, F.col(order))).over(W.partitionBy(key)))
    return m.where(F.col("__first").isNull() | (F.col(order) != F.col("__first"))).select(*df.columns)


def velocity_fit(df: DataFrame, key: str, order: str, t: str, x: str, y: str, min_spread: float = 1e-9, passes: int = 0, min_gain: float = 0.0) -> DataFrame:
    """One row per track: status, reason, n, used (orders kept), and the fit, null without one.

    vx, vy per second, intercepts, speed, angle, r2_x, r2_y, rms. Outlier passes each drop one row at most.
    """
    check_options(min_spread, passes, min_gain)
    why = detection_reason(df, key, order, t, x, y)
    rows = df.join(why.where("reason is null").select(key), key, "left_semi").select(key, order, t, x, y)
    for _ in range(passes):
        rows = _leave_one_out(rows, key, order, t, x, y, min_spread, min_gain)
    m = _moments(rows, key, t, x, y)
    m = m.withColumns({"__vx": F.try_divide(F.col("__tx"), F.col("__tt")), "__vy": F.try_divide(F.col("__ty"), F.col("__tt"))})
    rx, ry = F.col("__x") - F.col("__vx") * F.col("__t"), F.col("__y") - F.col("__vy") * F.col("__t")
    first = lambda name: F.first(name).alias(name)
    g = m.groupBy(key).agg(
        F.count(F.lit(1)).alias("used_count"), F.array_sort(F.collect_list(order)).alias("used"), F.sum(rx * rx).alias("sx"), F.sum(ry * ry).alias("sy"),
        *[first(f"__{k}") for k in ("mt", "mx", "my", "vx", "vy", "tt", "xx", "yy")],
    )
    vx, vy = F.col("__vx"), F.col("__vy")
    # A coordinate that never changes is fitted exactly or not at all.
    r2 = lambda total, rest: F.when(F.col(total) == 0, F.when(F.col(rest) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.col(rest), F.col(total)))
    fit = g.select(
        key, "used_count", "used", F.col("__tt").alias("time_spread"), vx.alias("vx"), vy.alias("vy"),
        (F.col("__mx") - vx * F.col("__mt")).alias("x0"), (F.col("__my") - vy * F.col("__mt")).alias("y0"), F.hypot(vx, vy).alias("speed"), launch_angle(vx, vy).alias("angle"),
        r2("__xx", "sx").alias("r2_x"), r2("__yy", "sy").alias("r2_y"), F.sqrt((F.col("sx") + F.col("sy")) / F.col("used_count")).alias("rms"),
    )
    out = why.join(fit, key, "left")
    values = ("used_count", "used", "vx", "vy", "x0", "y0", "speed", "angle", "r2_x", "r2_y", "rms")
    reason = F.coalesce("reason", first_reason((~(F.coalesce(F.col("time_spread"), F.lit(0.0)) > min_spread), "BAD_TIMESTAMP"), (~all_finite("vx", "vy", "x0", "y0", "rms"), "NON_FINITE_FIT")))
    out = out.withColumn("reason", reason)
    return out.select(key, F.when(F.col("reason").isNull(), "OK").otherwise("NO_READ").alias("status"), "reason", "n", *[F.when(F.col("reason").isNull(), F.col(v)).alias(v) for v in values])


def measurement(fit: DataFrame, scale: Column | str, max_rms: float) -> DataFrame:
    """The fit with feet_per_second and mph; residual and calibration gates may turn it into a NO_READ without values."""
    fps = pixels_to_feet_per_second("speed", scale)
    good_scale = is_finite(scale) & (c(scale) > 0)
    reason = F.coalesce(first_reason((~good_scale, "INVALID_CALIBRATION")), F.col("reason"), first_reason((F.col("rms") > max_rms, "EXCESSIVE_RESIDUAL")))
    out = fit.withColumns({"reason": reason, "feet_per_second": fps, "mph": feet_per_second_to_mph(fps)})
    out = out.withColumn("status", F.when(F.col("reason").isNull(), "OK").otherwise("NO_READ"))
    return out.withColumns({v: F.when(F.col("reason").isNull(), F.col(v)) for v in ("used_count", "used", "vx", "vy", "x0", "y0", "speed", "angle", "r2_x", "r2_y", "rms", "feet_per_second", "mph")})
