"""Image, track, audio and flight kernels; stream equals batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotrack.operators import audio as A
from chronotrack.operators import images as I
from chronotrack.operators import physics as B
from chronotrack.operators import track as T
from chronotrack.plans import pipelines as Q
from chronotrack.streaming import impact as M
from chronotrack.streaming import workflow as S

RED, BLACK = -65536, -16777216


def frame(points, w=8, h=8, size=1):
    p = np.full((h, w), BLACK)
    for x, y in points:
        p[y : y + size, x : x + size] = RED
    return p.ravel().tolist()


def test_single_blob():
    reason, blobs = I.detect_frame(frame([(3, 4), (4, 4), (3, 5), (4, 5)]), 8, 8, I.BlobConfig())
    assert reason is None
    assert (blobs[0]["area"], blobs[0]["cx"], blobs[0]["cy"]) == (4, 3.5, 4.5)


def test_blob_rejects(spark):
    rows = [("a", 0, 0.0, 8, 8, frame([])), ("a", 1, 0.1, 8, 8, frame([(1, 1), (6, 6)])), ("a", 2, 0.2, 8, 8, frame([(1, 1)])), ("a", 3, 0.3, 8, 8, [1, 2])]
    df = spark.createDataFrame(rows, "clip_id string, frame_index int, t_s double, width int, height int, pixels array<int>")
    got = {r.frame_index: r.kind for r in I.single_blob(I.detect_blobs(df, I.BlobConfig())).collect()}
    assert got == {0: "NO_BLOB", 1: "AMBIGUOUS_BLOBS", 2: None, 3: "INVALID_INPUT"}
    got = {r.frame_index: r.kind for r in I.single_blob(I.detect_blobs(df.limit(3), I.BlobConfig(min_area=2, region=(4, 0, 8, 4)))).collect()}
    assert set(got.values()) == {"NO_BLOB"}


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = rng.random((9, 11)) < 0.5
        lab, want, n = I.label(m), np.zeros(m.shape, int), 0
        for y in range(9):
            for x in range(11):
                if m[y, x] and not want[y, x]:
                    n, stack = n + 1, [(y, x)]
                    want[y, x] = n
                    while stack:
                        b, a = stack.pop()
                        for q, p in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                            if 0 <= q < 9 and 0 <= p < 11 and m[q, p] and not want[q, p]:
                                want[q, p] = n
                                stack.append((q, p))
        assert (lab == want).all()


def test_shapes():
    disk = (np.add.outer((np.arange(11) - 5) ** 2, (np.arange(11) - 5) ** 2)) <= 20
    y, x = np.nonzero(disk)
    assert I.axis_ratio(x, y) == pytest.approx(1.0)
    assert I.hull_solidity(x, y) > 0.85 and I.roundness(disk) > 0.5
    bar = np.zeros((11, 11), bool)
    bar[5] = True
    y, x = np.nonzero(bar)
    assert I.axis_ratio(x, y) > 5
    assert (I.opened(disk) <= disk).all() and (I.closed(disk) >= I.erode(disk)).all()
    assert I.circular_mean(np.array([350.0, 10.0])) % 360 == pytest.approx(0, abs=1e-9)


def test_shift():
    a = np.random.default_rng(1).integers(0, 255, (20, 20))
    assert I.dominant_shift(a, np.roll(a, (1, -2), (0, 1))) == (-2, 1)


def test_yuv():
    y = np.full((2, 6), 235, np.uint8)
    y[:, 2:] = 16
    raw = y.tobytes() + np.full((1, 6), 128, np.uint8).tobytes()
    out = I.yuv_to_argb(raw, 4, 2, 6, 2, "NV12", 4, 2)
    assert (out[:, :2] & 255 > 250).all() and (out[:, 2:] & 255 < 5).all()
    assert (I.yuv_to_argb(y.tobytes() + bytes([128] * 6), 4, 2, 6, 2, "I420", 2, 1) & 255).tolist() == [[255, 0]]


def test_fnv():
    assert I.fnv1a([]) == I.FNV_BASIS
    assert I.fnv1a([97]) == 0xAF63DC4C8601EC8C


def moving(spark, xs, times, size=2):
    rows = [("c", i, float(t), 40, 12, frame([(x, 5)], 40, 12, size)) for i, (x, t) in enumerate(zip(xs, times))]
    return spark.createDataFrame(rows, "clip_id string, frame_index int, t_s double, width int, height int, pixels array<int>")


def test_frames_to_estimate(spark):
    cal = spark.createDataFrame([("c", 3.0, 1.0)], "clip_id string, pixels double, feet double")
    r = Q.estimate_from_frames(moving(spark, [0, 3, 6, 21], [0, 0.01, 0.02, 0.07]), cal, I.BlobConfig()).first()
    assert r.mph == pytest.approx(68.18182, abs=1e-4)
    assert r.confidence == "LOW"
    r = Q.estimate_from_frames(moving(spark, [0, 3, 6, 9, 12], [0, 0.01, 0.02, 0.03, 0.04]), cal, I.BlobConfig(), directional=True).first()
    assert (r.status, r.confidence) == ("OK", "MEDIUM")


def test_straight_flight_is_found():
    flight = [[{"x": 5.0 + 4 * i, "y": 5.0, "t": i / 120, "left": 0, "top": 0, "right": 2, "bottom": 2, "compactness": 0.8, "area": 6, "frame": i}, {"x": 30.0, "y": 20.0 + i % 2, "t": i / 120, "left": 0, "top": 0, "right": 2, "bottom": 2, "compactness": 0.8, "area": 6, "frame": i}] for i in range(8)]
    for found in (T.ransac_track(flight, T.TrackConfig()), T.directional_track(flight, T.TrackConfig()), T.seeded_track(flight, T.TrackConfig(seed=(5.0, 5.0)))):
        assert [b["y"] for b in found] == [5.0] * 8
    assert T.ransac_track(flight, T.TrackConfig(ransac=3)) is None


POP = A.TriggerConfig(baseline=100, window=20, ratio=2.5, peak_delta=1000, floor_rms=1.0, ready=0, accept=0, longest=600, actionable=600)


def pop():
    s = np.full(600, 100)
    s[220], s[221] = 12000, -10500
    return s


def test_pop_and_quiet():
    d = A.Detector(POP)
    r = dict(zip(A.COLUMNS, d.feed(pop())))
    assert (r["status"], r["sample_index"], r["peak"]) == ("DETECTED", 220, 12000)
    d = A.Detector(POP)
    assert (d.feed(np.full(600, 80)) or d.finish())[0] == "NO_IMPACT"
    assert A.Detector(A.TriggerConfig(ratio=0.5)).finish()[0] == "RESOURCE_FAILURE"


@pytest.mark.parametrize("size", [1, 7, 64, 599])
def test_chunks_change_nothing(size):
    whole, parts = A.Detector(POP), A.Detector(POP)
    want, got = whole.feed(pop()), None
    for k in range(0, 600, size):
        got = parts.feed(pop()[k : k + size]) or got
    assert got[:6] == want[:6] and got[7:] == want[7:]


def test_late_bounds():
    d = A.Detector(A.TriggerConfig(**{**POP.__dict__, "ready": A.UNSET, "accept": A.UNSET}))
    assert d.feed(pop()) is None
    assert d.bounds(0, 50)[0] == "DETECTED"


def stream_rows(spark):
    rows = [(s, k, "samples", pop()[k * 100 : k * 100 + 100].tolist() if s == "a" else [80] * 100, None, None) for s in "ab" for k in range(6)]
    rows += [("a", 6, "end", None, None, None), ("b", 6, "end", None, None, None), ("c", 1, "samples", [1] * 10, None, None)]
    return spark.createDataFrame(rows, M.INPUT)


def test_stream_equals_batch(spark, tmp_path):
    rows = stream_rows(spark)
    batch = {r.session_id: r for r in M.detect_batch(rows, POP).collect()}
    assert {k: v.status for k, v in batch.items()} == {"a": "DETECTED", "b": "NO_IMPACT", "c": "OUT_OF_ORDER"}
    for k in range(7):
        rows.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(M.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = M.detect_stream(live, POP).writeStream.format("memory").queryName("impacts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.session_id: r for r in spark.sql("select * from impacts").collect()}
    assert {k: (v.status, v.sample_index, v.peak) for k, v in got.items()} == {k: (v.status, v.sample_index, v.peak) for k, v in batch.items()}


def test_workflow(spark):
    rows = [("s", i, e, p) for i, (e, p) in enumerate([("REQUEST_PICKER", None), ("SELECTION_VALIDATED", "u"), ("METADATA_VALIDATED", "m"), ("FRAMES_EXTRACTED", "f"), ("START_ESTIMATE", None), ("ESTIMATE_COMPLETED", "x")])]
    r = S.fold(spark.createDataFrame(rows, S.EVENTS), "import").first()
    assert (r.stage, r.access, r.metadata, r.frames, r.outcome) == ("SUCCESS", "u", "m", "f", "x")
    r = S.fold(spark.createDataFrame([("s", 0, "CALIBRATION_READY", None), ("s", 1, "ARM", None)], S.EVENTS), "measurement").first()
    assert (r.capture, r.reason) == ("NOT_READY", "COLOUR_MISSING")


def test_closed_form_without_drag():
    v, a, h, w = (np.array([x]) for x in (20.0, 40.0, 1.0, 0.0))
    _, carry, apex, hang = B.flight(v, a, h, w, density=0.0)
    vy, vx = 20 * np.sin(np.radians(40)), 20 * np.cos(np.radians(40))
    t = (vy + np.sqrt(vy * vy + 2 * 9.81)) / 9.81
    assert (carry[0], apex[0], hang[0]) == pytest.approx((vx * t, 1 + vy * vy / 2 / 9.81, t), abs=0.01)


@pytest.mark.parametrize("mph, angle, height, rpm, want", [
    (70, 25, 0, 0, (52.794519, 7.262282, 2.426099)), (70, 25, 0, 1800, (66.862305, 11.106563, 3.495129)), (70, 25, 0, -1800, (40.926951, 5.133826, 1.727003)), (70, 25, 1.2192, 0, (54.584585, 8.481482, 2.532442)), (60, 15, 1.2192, 1800, (44.974009, 4.687659, 2.190096)),
])
def test_flight(mph, angle, height, rpm, want):
    reason, *got = B.flight([mph / 2.2369362920544], [angle], [height], [rpm])
    assert reason[0] is None
    assert tuple(x[0] for x in got) == pytest.approx(want, abs=1e-5)


def test_flight_edges(spark):
    df = spark.createDataFrame([(0, 10.0, 95.0, 0.0, 0.0), (1, 0.0, 10.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0, 0.0), (3, 10.0, 10.0, 0.0, float("nan"))], "k int, s double, a double, h double, w double")
    r = {x.k: x for x in B.trajectory_summary(df, "k", "s", "a", "h", "w").collect()}
    assert (r[0].reason, r[2].reason, r[3].reason) == ("INVALID_LAUNCH", "INVALID_LAUNCH", "INVALID_AIR")
    assert (r[1].status, r[1].carry_m, r[0].carry_m) == ("OK", 0.0, None)


def test_expected_ball_size():
    c = I.MotionConfig(expected=(100.0, 10.0, 12.0))
    blob = lambda area, w, h: {"area": area, "left": 3, "right": 2 + w, "top": 5, "bottom": 4 + h}
    assert I.expected_size_score(blob(100, 12, 10), c) == 1.0
    assert I.expected_size_score(blob(90, 10, 9), c) == pytest.approx(1 - 1 / 6)
    assert I.expected_size_score(blob(100, 20, 10), c) == pytest.approx(1 - 2 / 3)
    assert I.expected_size_score(blob(34, 10, 12), c) is None and I.expected_size_score(blob(251, 10, 12), c) is None
    assert I.expected_size_score(blob(100, 25, 10), c) is None


def test_one_large_shift_is_camera_motion():
    plane = np.random.default_rng(4).integers(0, 256, (24, 24))
    still = np.stack([plane] * 5)
    jump = np.stack([plane, plane, plane, np.roll(plane, (2, 2), (0, 1)), np.roll(plane, (2, 2), (0, 1))])
    assert not I.camera_moved(still, I.MotionConfig())
    assert I.camera_moved(jump, I.MotionConfig(max_single_shift=2.0)) and not I.camera_moved(jump, I.MotionConfig())
