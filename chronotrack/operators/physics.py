"""Flight of a ball with quadratic drag and spin lift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.functions.numeric import FEET_PER_METRE, c, mph_to_metres_per_second

# Fixed model constants: a 12-inch ball at sea level, and the lift curve 2.5 S / (1 + 5.8 S).
DIAMETER_M, MASS_KG = 0.0955, 0.1899
AIR_DENSITY, DRAG_COEFFICIENT = 1.225, 0.40
LIFT_RISE, LIFT_BEND = 2.5, 5.8
STEP_S, LONGEST_S, GRAVITY = 0.001, 15.0, 9.81
BACKSPIN_RPM = 1800.0
SUMMARY = "status string, reason string, carry_m double, apex_m double, hang_s double"


def flight(speed, angle, height, rpm, density=AIR_DENSITY, drag=DRAG_COEFFICIENT, step=STEP_S, longest=LONGEST_S, gravity=GRAVITY, trace=None):
    """Carry, apex and hang of many launches at once; all arrays alike. reason is None where there is a result.

    Fourth-order Runge-Kutta steps run over all launches still in the air. ``trace``: called with the indexes and states
    of each step (t, x, y, vx, vy), the first one and the crossing of the ground included.
    """
    speed, angle, height, rpm = (np.asarray(v, float) for v in (speed, angle, height, rpm))
    n = len(speed)
    reason = np.full(n, None, object)
    bad = ~np.isfinite(speed) | (speed < 0) | ~np.isfinite(angle) | (np.abs(np.where(np.isfinite(angle), angle, 0)) > 90) | ~np.isfinite(height) | (height < 0)
    reason[bad] = "INVALID_LAUNCH"
    reason[~bad & ~np.isfinite(rpm)] = "INVALID_AIR"
    carry, apex, hang = (np.full(n, np.nan) for _ in range(3))
    good = reason == None  # noqa: E711
    rest = good & (height == 0) & ((speed == 0) | (angle <= 0))
    carry[rest], apex[rest], hang[rest] = 0.0, height[rest], 0.0
    if trace and rest.any():
        trace(np.nonzero(rest)[0], np.zeros((5, int(rest.sum()))))
    at = np.nonzero(good & ~rest)[0]
    a = np.radians(angle[at])
    exact = lambda v: np.where(np.abs(v) < 1e-12, 0.0, v)
    s = np.stack([np.zeros(len(at)), height[at], speed[at] * exact(np.cos(a)), speed[at] * exact(np.sin(a))])
    t, top, spin = np.zeros(len(at)), height[at].copy(), rpm[at]
    area = math.pi * (DIAMETER_M / 2) ** 2
    push = 0.5 * density * area / MASS_KG
    if trace and len(at):
        trace(at, np.vstack((t, s)))

    def slope(s, spin):
        v = np.hypot(s[2], s[3])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = DIAMETER_M / 2 * np.abs(spin) * (2 * math.pi / 60) / v
            lift = np.where((v > 0) & (spin != 0), np.sign(spin) * push * LIFT_RISE * ratio / (1 + LIFT_BEND * ratio) * v, 0.0)
        slow = push * drag * v
        return np.stack([s[2], s[3], -slow * s[2] - lift * s[3], -gravity - slow * s[3] + lift * s[2]])

    while len(at):
        dt = np.minimum(step, longest - t)
        k1 = slope(s, spin)
        k2 = slope(s + k1 * (dt / 2), spin)
        k3 = slope(s + k2 * (dt / 2), spin)
        k4 = slope(s + k3 * dt, spin)
        new, nt = s + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4), t + dt
        lost = ~np.isfinite(new).all(axis=0)
        down = ~lost & (s[1] > 0) & (new[1] <= 0)
        part = np.where(down, s[1] / np.where(down, s[1] - new[1], 1), 0)
        end = s + (new - s) * part
        carry[at[down]], hang[at[down]], apex[at[down]] = end[0][down], (t + (nt - t) * part)[down], top[down]
        late = ~lost & ~down & (nt >= longest)
        reason[at[lost]], reason[at[late]] = "NON_FINITE_STATE", "NO_GROUND_INTERSECTION"
        if trace:
            end[1] = 0.0
            trace(at, np.where(down, np.vstack((t + (nt - t) * part, end)), np.vstack((nt, new))))
        go = ~(lost | down | late)
        at, s, t, spin, top = at[go], new[:, go], nt[go], spin[go], np.maximum(top[go], new[1][go])
    return reason, carry, apex, hang


def trajectory_summary(launches: DataFrame, key: str, speed: str, angle: str, height: str, rpm: str) -> DataFrame:
    """One row per launch: status, reason, carry_m, apex_m, hang_s. Rows are simulated in Arrow batches, without a shuffle."""
    rows = launches.select(key, *[c(x).cast("double").alias(n) for x, n in ((speed, "s"), (angle, "a"), (height, "h"), (rpm, "w"))])

    def run(batches):
        for b in batches:
            reason, carry, apex, hang = flight(b.s, b.a, b.h, b.w)
            ok = np.array([r is None for r in reason], bool)
            yield pd.DataFrame({key: b[key], "status": np.where(ok, "OK", "NO_READ"), "reason": reason, "carry_m": carry, "apex_m": apex, "hang_s": hang})

    out = rows.mapInPandas(run, f"{key} {launches.schema[key].dataType.simpleString()}, {SUMMARY}")
    return out.withColumns({k: F.when(F.col("status") == "OK", F.col(k)) for k in ("carry_m", "apex_m", "hang_s")})


def trajectory_samples(launches: DataFrame, key: str, speed: str, angle: str, height: str, rpm: str, every: int = 50) -> DataFrame:
    """Every ``every``-th step of each successful launch and its last one: step, t, x, y, vx, vy."""
    rows = launches.select(key, *[c(x).cast("double").alias(n) for x, n in ((speed, "s"), (angle, "a"), (height, "h"), (rpm, "w"))])

    def run(batches):
        for b in batches:
            kept, count = [], np.zeros(len(b), np.int64)

            def trace(at, state, kept=kept, count=count):
                done = (state[2] <= 0) & (count[at] > 0)
                use = (count[at] % every == 0) | done
                kept.append(np.vstack((at[use], count[at][use], state[:, use])))
                count[at] += 1

            reason, *_ = flight(b.s, b.a, b.h, b.w, trace=trace)
            rows = np.concatenate(kept, axis=1) if kept else np.zeros((7, 0))
            at = rows[0].astype(int)
            ok = np.array([reason[i] is None for i in at], bool)
            yield pd.DataFrame({key: b[key].to_numpy()[at[ok]], "step": rows[1][ok].astype(np.int64), **{n: rows[k + 2][ok] for k, n in enumerate(("t", "x", "y", "vx", "vy"))}})

    return rows.mapInPandas(run, f"{key} {launches.schema[key].dataType.simpleString()}, step long, t double, x double, y double, vx double, vy double")


def carry_range(launches: DataFrame, key: str, mph: str, angle: str, height_ft: float = 4.0) -> DataFrame:
    """Carry in feet without spin and with the assumed backspin, and the line that says so."""
    rows = launches.select(key, mph_to_metres_per_second(mph).alias("s"), F.col(angle).alias("a"), F.lit(height_ft / FEET_PER_METRE).alias("h"), F.lit(0.0).alias("plain"), F.lit(BACKSPIN_RPM).alias("spun"))
    one = lambda w, n: trajectory_summary(rows, key, "s", "a", "h", w).select(key, (F.col("carry_m") * FEET_PER_METRE).alias(n))
    out = one("plain", "drag_only_ft").join(one("spun", "backspin_ft"), key)
    return out.withColumn("line", F.when(F.col("drag_only_ft").isNotNull() & F.col("backspin_ft").isNotNull(), F.format_string("carry %.0f-%.0f ft", "drag_only_ft", "backspin_ft")))
