"""Golden values of fits, measurements, estimates and calibration."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotrack.functions import numeric as N
from chronotrack.operators import estimate as E
from chronotrack.operators import fit as V


def track(spark, rows, name="a"):
    return spark.createDataFrame([(name, i, float(t), float(x), float(y)) for i, (t, x, y) in enumerate(rows)], "track_id string, seq int, t double, x double, y double")


def fit(spark, rows, **kw):
    return V.velocity_fit(track(spark, rows), "track_id", "seq", "t", "x", "y", **kw).first()


LINE = [(0, 10, 100), (1, 40, 60), (2, 70, 20), (3, 100, -20)]


def test_exact_line(spark):
    f = V.velocity_fit(track(spark, LINE), "track_id", "seq", "t", "x", "y")
    m = V.measurement(f, F.lit(10.0), 2.0).first()
    assert (m.vx, m.vy, m.x0, m.y0, m.r2_x, m.r2_y) == pytest.approx((30, -40, 10, 100, 1, 1))
    assert m.rms == pytest.approx(0, abs=1e-9)
    assert (m.speed, m.feet_per_second, m.mph, m.angle) == pytest.approx((50, 5, 3.409091, 53.13010235415598), abs=1e-6)


def test_outlier_goes(spark):
    f = fit(spark, [(0, 0, 0), (1, 10, 5), (2, 200, 200), (3, 30, 15), (4, 40, 20)], passes=1, min_gain=1.0)
    assert f.used == [0, 1, 3, 4]
    assert (f.vx, f.vy) == pytest.approx((10, 5))
    assert f.rms == pytest.approx(0, abs=1e-9)


CLEAN = [(0, 0, 0), (1, 10, 5), (2, 20, 10), (3, 30, 15)]


def test_clean_line_keeps_all_and_floor_holds(spark):
    assert fit(spark, CLEAN, passes=1, min_gain=0.1).used == [0, 1, 2, 3]
    assert fit(spark, CLEAN, passes=10, min_gain=0.0).used_count >= 3


@pytest.mark.parametrize("rows, reason", [(LINE[:2], "INSUFFICIENT_DETECTIONS"), ([(0, math.nan, 0), *LINE[1:]], "INVALID_DETECTION"), ([(5, 0, 0), *LINE[1:]], "BAD_TIMESTAMP")])
def test_failures_have_no_values(spark, rows, reason):
    f = fit(spark, rows)
    assert (f.status, f.reason, f.vx, f.rms) == ("NO_READ", reason, None, None)


def test_options_are_checked():
    for bad in ({"min_spread": 0.0, "passes": 0, "min_gain": 0.0}, {"min_spread": 1.0, "passes": -1, "min_gain": 0.0}, {"min_spread": 1.0, "passes": 0, "min_gain": math.nan}):
        with pytest.raises(ValueError):
            V.check_options(**bad)


def test_residual_and_calibration_gates(spark):
    f = V.velocity_fit(track(spark, [(0, 0, 0), (1, 10, 5), (2, 200, 200), (3, 30, 15)]), "track_id", "seq", "t", "x", "y")
    assert V.measurement(f, F.lit(10.0), 2.0).first().reason == "EXCESSIVE_RESIDUAL"
    assert V.measurement(f, F.lit(0.0), 2.0).first().reason == "INVALID_CALIBRATION"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=5, max_size=9))
def test_first_pass_equals_brute_force(spark, points):
    rows = [(i + 0.1 * (i % 3), x, y) for i, (x, y) in enumerate(points)]
    a = np.array(rows)

    def rms(a):
        t = a[:, 0] - a[:, 0].mean()
        return math.sqrt(sum(((a[:, k] - a[:, k].mean() - t * (t @ a[:, k]) / (t @ t)) ** 2).sum() for k in (1, 2)) / len(a))

    f = fit(spark, rows, passes=1, min_gain=1e-6)
    best = min(rms(np.delete(a, i, 0)) for i in range(len(a)))
    assert f.rms == pytest.approx(best if rms(a) - best >= 1e-6 else rms(a), abs=1e-6)


def test_calibration_and_units(spark):
    r = spark.range(1).select(N.pixels_per_foot(F.lit(100.0), F.lit(2.5)).alias("a"), N.calibration_reason(F.lit(0.0), F.lit(1.0)).alias("b"), N.calibration_reason(F.lit(1.0), F.lit(-1.0)).alias("c"), N.known_distance_scale(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))[1].alias("d"), N.feet_per_second_to_mph(F.lit(4.0)).alias("e"), N.inches_to_feet(F.lit(24.0)).alias("f"), N.centimetres_to_feet(F.lit(91.44)).alias("g")).first()
    assert (r.a, r.b, r.c, r.d) == (40.0, "INVALID_PIXEL_DISTANCE", "INVALID_REAL_DISTANCE", "INVALID_POINT")
    assert (r.e, r.f, r.g) == pytest.approx((2.7272728, 2.0, 3.0))


def estimate(spark, samples, pixels, feet, config=None, interval=None, diameters=None):
    rows = [("a", i, float(t), float(x), float(y), float(diameters[i]) if diameters else None) for i, (t, x, y) in enumerate(samples)]
    df = spark.createDataFrame(rows, "k string, seq int, t double, x double, y double, size double")
    cal = spark.createDataFrame([("a", pixels, feet)], "k string, pixels double, feet double")
    return E.estimate(df, "k", "seq", "t", "x", "y", "size", cal, "pixels", "feet", config, interval).first()


def test_uneven_gaps_estimate(spark):
    r = estimate(spark, [(0, 0, 0), (0.1, 10, 0), (0.3, 30, 0), (0.6, 60, 0)], 10.0, 10.0)
    assert (r.status, r.detection_count) == ("OK", 4)
    assert r.mph == pytest.approx(68.18182 / 10, abs=1e-4) or r.mph == pytest.approx(68.18182, abs=1e-4)
    assert r.angle == pytest.approx(0)


def test_stationary_prefix(spark):
    r = estimate(spark, [(0, 0, 0), (0.01, 0, 0), (0.02, 3, 0), (0.03, 6, 0), (0.08, 21, 0), (0.09, 24, 0)], 3.0, 1.0, diameters=[9, 9, 5, 5, 5, 5])
    assert (r.status, r.detection_count) == ("OK", 4)
    assert r.mph == pytest.approx(68.18182, abs=1e-4)


def test_frame_deltas(spark):
    r = estimate(spark, [(0, 0, 0), (0, 3, 0), (0, 6, 0), (0, 21, 0)], 3.0, 1.0, interval=0.01)
    assert r.mph == pytest.approx(68.18182, abs=1e-4)
    assert r.confidence == "LOW"


def test_ball_diameter_scale(spark):
    r = estimate(spark, [(0, 0, 0), (0.1, 10, 0), (0.2, 20, 0), (0.3, 30, 0)], None, None, E.EstimateConfig(ball_feet=1.0), diameters=[5] * 4)
    assert r.mph == pytest.approx(13.63636, abs=1e-4)


def test_level_correction_and_depth(spark):
    r = estimate(spark, [(i * 0.1, i * 10, -i * 10) for i in range(6)], 10.0, 10.0, E.EstimateConfig(roll=10.0))
    assert r.angle == pytest.approx(35.0, abs=1e-3)
    flat = [(i * 0.1, i * 10, 0) for i in range(6)]
    a, b = estimate(spark, flat, 10.0, 10.0), estimate(spark, flat, 10.0, 10.0, E.EstimateConfig(ball_depth=1.0, plane_depth=7.0))
    assert b.mph == pytest.approx(a.mph / 7)
    assert (a.confidence, b.confidence) == ("HIGH", "MEDIUM")


@pytest.mark.parametrize("samples, config, reason", [
    ([(0, 0, 0), (0.1, 10, 0), (0.2, 20, 0)], None, "INSUFFICIENT_DETECTIONS"), ([(0, 0, 0)], None, "BAD_TIMESTAMPS"), ([(0, 0, 0), (0, 10, 0), (0.2, 20, 0), (0.3, 30, 0)], None, "BAD_TIMESTAMPS"),
    ([(0, 0, 0), (0.1, 10, 0), (0.2, 20, 0), (1.9, 30, 0)], None, "AMBIGUOUS_TRACK"), ([(i * 0.1, i * 10, 9 * (i % 2)) for i in range(6)], None, "EXCESSIVE_RESIDUAL"),
    ([(i * 0.1, i * 10, 0) for i in range(5)], E.EstimateConfig(min_mph=500.0), "AMBIGUOUS_TRACK"),
])
def test_estimate_gates(spark, samples, config, reason):
    r = estimate(spark, samples, 10.0, 10.0, config)
    assert (r.status, r.reason, r.mph, r.confidence) == ("NO_READ", reason, None, None)


def test_missing_calibration(spark):
    assert estimate(spark, [(i * 0.1, i * 10, 0) for i in range(5)], None, None).reason == "BAD_CALIBRATION"


def test_still_track_has_no_frame_deltas(spark):
    assert estimate(spark, [(0, 5, 5)] * 5, 3.0, 1.0, interval=0.01).reason == "AMBIGUOUS_TRACK"
