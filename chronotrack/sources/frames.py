"""Scans of clips: time ranges, sample windows, bounded extraction, metadata gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.numeric import first_reason

FRAME_SCHEMA = "clip_id string, frame_index int, t_s double, pts_ns long, width int, height int, pixels array<int>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames stored as Parquet, fixed schema: column pruning and row groups by clip and time come with the format."""
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def sample_window(df: DataFrame, key: str, order: str, start: int, most: int) -> DataFrame:
    """Samples start + 1 to start + most of each clip."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(order))
    return df.withColumn("rn", rn).where(F.col("rn").between(start + 1, start + most))


def time_window(df: DataFrame, key: str, at: str, start, end, most: int) -> DataFrame:
    """Frames in [start, end] of each clip, the first ``most``. The range filter reaches the scan."""
    kept = df.where(F.col(at).between(start, end))
    return kept.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(at))).where(F.col("rn") <= most)


def bounded_extract(df: DataFrame, key: str, most: int) -> DataFrame:
    """Clips of at most ``most`` frames; a larger one fails as a whole instead of being cut."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("frames")).withColumn("reason", F.when(F.col("frames") > most, "FRAME_LIMIT").when(F.col("frames") == 0, "EMPTY"))


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count(F.lit(1)).alias("frames"))


def metadata_reason(mime: Column, w: Column, h: Column, duration_us: Column, count: Column, increasing: Column) -> Column:
    """First reason why a clip's metadata can't be used."""
    return first_reason(
        (~F.coalesce(mime.startswith("video/"), F.lit(False)), "NOT_VIDEO"), (~((w > 0) & (h > 0)), "BAD_SIZE"), (~(duration_us > 0), "BAD_DURATION"), (count < 2, "TOO_FEW_SAMPLES"), (~increasing, "BAD_TIMESTAMPS")
    )


def capture_reason(decoded: Column, scanned: Column, unique: Column, median_gap: Column, expected: Column, duration: Column) -> Column:
    """Whole-capture gate: counts agree, cadence in the band, positive duration."""
    return first_reason(((decoded != scanned) | (scanned != unique), "COUNT_MISMATCH"), (~F.coalesce(median_gap.between(expected * 0.85, expected * 1.15), F.lit(False)), "BAD_CADENCE"), (~(duration > 0), "BAD_DURATION"))


def window_reason(count: Column, low: int, high: int, inside: Column, source: Column, proof: Column) -> Column:
    return first_reason((~count.between(low, high), "COUNT_OUT_OF_BOUNDS"), (~inside, "OUTSIDE_WINDOW"), (source != "VALID", "SOURCE_INVALID"), (~proof, "PROOF_MISSING"))


def every_nth(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("rn", rn).where(F.pmod("rn", F.lit(n)) == 0)


def strided(df: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """At most ``budget`` rows of each key, evenly strided."""
    w = W.partitionBy(key)
    d = df.withColumns({"rn": F.row_number().over(w.orderBy(order)) - 1, "n": F.count(F.lit(1)).over(w)})
    return d.where((F.pmod("rn", F.greatest(F.lit(1), F.ceil(F.col("n") / budget))) == 0)).drop("n")
