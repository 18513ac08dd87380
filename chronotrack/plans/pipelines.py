"""Composite pipelines: frames to estimates, clock proofs, evidence documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.operators.estimate import RECORDED, EstimateConfig, estimate
from chronotrack.operators.images import BlobConfig, MotionConfig, detect_blobs, detect_in_clips, sequence_identity, signature_verdict, signatures, single_blob
from chronotrack.operators.pairing import constant_offset, lookup
from chronotrack.operators.track import TrackConfig, assign_runs, best_run, budget_reason, extract_track, reduce_candidates
from chronotrack.session import reused
from chronotrack.sources.frames import time_window


def _samples(blobs: DataFrame, directional: bool, track: TrackConfig) -> DataFrame:
    if directional:
        return reduce_candidates(blobs, track)
    s = single_blob(reused(blobs))
    why = extract_track(s, "clip_id", track.jump, track.interior_misses, 4)
    good = s.where("blob is not null").join(why.where("reason is null").select("clip_id"), "clip_id", "left_semi")
    rows = good.select("clip_id", F.lit(None).cast("string").alias("reason"), "frame_index", "t_s", F.col("blob.cx").alias("x"), F.col("blob.cy").alias("y"), (2 * F.sqrt(F.col("blob.area") / 3.141592653589793)).alias("diameter"))
    null = lambda n, t: F.lit(None).cast(t).alias(n)
    return rows.unionByName(why.where("reason is not null").select("clip_id", "reason", null("frame_index", "int"), null("t_s", "double"), null("x", "double"), null("y", "double"), null("diameter", "double")))


def estimate_from_frames(frames: DataFrame, calibration: DataFrame, blob: BlobConfig, config: EstimateConfig | None = None, track: TrackConfig | None = None, timing: str = "REQUIRE_REAL", directional: bool = False, interval: float | None = None) -> DataFrame:
    """Frames to one estimate per clip. timing: REQUIRE_REAL, PREFER_REAL (falls back to displacement) or REQUIRE_VISUAL."""
    if timing == "REQUIRE_VISUAL" and not interval:
        raise ValueError("BAD_TIMESTAMPS: visual timing needs a frame interval")
    found = _samples(detect_blobs(frames, blob), directional, track or TrackConfig())
    return _estimate_samples(found, calibration, config or EstimateConfig(), timing, interval)


def _estimate_samples(found: DataFrame, calibration: DataFrame, config: EstimateConfig, timing: str, interval: float | None) -> DataFrame:
    found = reused(found)
    good = found.where("reason is null")
    args = (good, "clip_id", "frame_index", "t_s", "x", "y", "diameter", calibration, "pixels", "feet", config)
    out = estimate(*args, frame_interval=interval if timing == "REQUIRE_VISUAL" else None)
    if timing == "PREFER_REAL" and interval:
        second = estimate(*args, frame_interval=interval).where("status = 'OK'")
        redo = out.where("reason = 'BAD_TIMESTAMPS'").select("clip_id")
        out = out.join(redo.join(second.select("clip_id"), "clip_id"), "clip_id", "left_anti").unionByName(second.join(redo, "clip_id", "left_semi"))
    bad = found.where("reason is not null").groupBy("clip_id").agg(F.min("reason").alias("reason"))
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields if f.name not in ("clip_id", "status", "reason")]
    return out.unionByName(bad.select("clip_id", F.lit("NO_READ").alias("status"), "reason", *null))


def import_estimate(frames: DataFrame, times: DataFrame, calibration: DataFrame, blob: BlobConfig, config: EstimateConfig | None = None) -> DataFrame:
    """Frames meet reconciled times by position; clips whose counts differ are NO_READ."""
    w = W.partitionBy("clip_id")
    f = frames.withColumn("rn", F.row_number().over(w.orderBy("frame_index")))
    t = times.withColumn("rn", F.row_number().over(w.orderBy("t"))).select("clip_id", "rn", "t")
    n = f.groupBy("clip_id").agg(F.count(F.lit(1)).alias("a")).join(t.groupBy("clip_id").agg(F.count(F.lit(1)).alias("b")), "clip_id", "left").select("clip_id", (F.col("a") == F.coalesce("b", F.lit(0))).alias("same"))
    joined = f.join(n.where("same"), "clip_id", "left_semi").join(t, ["clip_id", "rn"]).withColumn("t_s", F.col("t"))
    out = estimate_from_frames(joined, calibration, blob, config)
    null = [F.lit(None).cast(x.dataType).alias(x.name) for x in out.schema.fields if x.name not in ("clip_id", "status", "reason")]
    return out.unionByName(n.where("not same").select("clip_id", F.lit("NO_READ").alias("status"), F.lit("TIMING_COUNT_MISMATCH").alias("reason"), *null)).withColumn("provenance", F.lit("imported"))


def motion_scout(hits: DataFrame, radius: float = 12.0, gap: int = 2, pad: int = 10, least_travel: float = 4.0) -> DataFrame:
    """Cheap pre-pass: the padded frame range of the run that travels furthest (hits: clip_id, frame_index, x, y, area)."""
    runs = assign_runs(hits, "clip_id", radius, gap)
    best = best_run(runs, "clip_id", "frame_index", "x", "area", 3, least_travel)
    return best.select("clip_id", F.greatest(F.col("first") - pad, F.lit(0)).alias("first"), (F.col("last") + pad).alias("last"), "rows", "travel")


def recorded_estimate(frames: DataFrame, calibration: DataFrame, detector: str = "motion", config: EstimateConfig | None = None, motion: MotionConfig | None = None, track: TrackConfig | None = None) -> DataFrame:
    """Recorded clips (pixels: luma): detector, candidate selection, estimate with the recorded profile."""
    blobs = reused(detect_in_clips(frames, detector, motion))
    refused = blobs.where("kind is not null").groupBy("clip_id").agg(F.min("kind").alias("reason"))
    found = reduce_candidates(blobs.where("kind is null"), track)
    null = [F.lit(None).cast(x.dataType).alias(x.name) for x in found.schema.fields if x.name not in ("clip_id", "reason")]
    found = found.unionByName(refused.select("clip_id", "reason", *null))
    return _estimate_samples(found, calibration, config or replace(RECORDED, ball_feet=None), "REQUIRE_REAL", None)


def window_estimate(frames: DataFrame, start: float, end: float, calibration: DataFrame, most: int = 240, **more) -> DataFrame:
    """The same over a time window of each clip; the range filter reaches the scan."""
    return recorded_estimate(time_window(frames, "clip_id", "t_s", start, end, most).drop("rn"), calibration, **more)


def direct_proof(direct: DataFrame, sensor: DataFrame, frames: DataFrame, key: str, at: str, bt: str, gap: int, expected: int) -> DataFrame:
    """Clock proof, signatures of the pixels and the identity of the sequence, with one verdict."""
    clock = constant_offset(direct, sensor, key, at, bt, 1000, gap).select(key, F.col("verdict").alias("clock"))
    signed = signatures(frames, [key, "frame_index"], "pixels")
    pixels = signature_verdict(signed, key, "frame_index", expected).select(key, F.col("verdict").alias("pixels"))
    identity = sequence_identity(signed, key, "frame_index", "signature", "checksum").select(key, "identity")
    out = clock.join(pixels, key, "full").join(identity, key, "left")
    good = F.coalesce(F.col("clock").isin("EXACT", "EQUIVALENT"), F.lit(False))
    return out.withColumn("proof", F.when(~good, "CLOCK_UNPROVEN").when(F.coalesce("pixels", F.lit("MISSING")) != "VALID", "PIXELS_UNPROVEN").otherwise("PROVEN"))


def proof_frames(frames: DataFrame, selected: DataFrame, key: str, most: int) -> DataFrame:
    """Frames of a proof document: the selected ones first, the rest evenly, in order, at most ``most``."""
    w = W.partitionBy(key)
    f = frames.select(key, "frame_index").distinct().join(selected.select(key, "frame_index").distinct().withColumn("chosen", F.lit(True)), [key, "frame_index"], "left")
    f = f.withColumns({"rn": F.row_number().over(w.orderBy("frame_index")) - 1, "n": F.count(F.lit(1)).over(w), "chosen": F.col("chosen").isNotNull()})
    even = F.floor(F.col("rn") * most / F.col("n")) != F.floor((F.col("rn") - 1) * most / F.col("n"))
    f = f.withColumn("place", F.row_number().over(w.orderBy(F.desc("chosen"), F.desc(even), "rn")))
    return f.where(F.col("place") <= most).select(key, "frame_index", "chosen")


def detector_trace(blobs: DataFrame, selected: DataFrame, clip: str = "clip_id", most: int = 16) -> DataFrame:
    """Per clip: frames, candidates (at most ``most`` a frame), frames without one, selected blobs."""
    t = blobs.join(selected.select(clip, "frame_index").distinct().withColumn("hit", F.lit(1)), [clip, "frame_index"], "left")
    n = F.size(F.slice("blobs", 1, most))
    return t.groupBy(clip).agg(F.count(F.lit(1)).alias("frames"), F.sum(n).alias("candidates"), F.count_if(n == 0).alias("empty_frames"), F.count("hit").alias("selected"))


__all__ = ["budget_reason", "detector_trace", "direct_proof", "estimate_from_frames", "import_estimate", "lookup", "motion_scout", "proof_frames", "recorded_estimate", "window_estimate"]
