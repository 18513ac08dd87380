"""Diagnostics of timestamp streams: gaps, islands, holes, medians, reconciled times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.numeric import c, expected_gap_ns, half_up

#: Share by which a median gap may differ from the expected one, and multiple of it from which a gap is a drop.
BAND, DROP = 0.15, 1.5


def _over(key: str, order: str) -> W:
    return W.partitionBy(key).orderBy(order)


def median_long(x) -> Column:
    """Median of whole numbers, the mean of the middle two cut off towards zero."""
    return F.median(c(x)).cast("long")


def upper_median(x) -> Column:
    """The higher of the middle two; 0.0 of nothing. The group's values are collected: groups are tracks or clips."""
    v = F.array_sort(F.collect_list(c(x)))
    return F.coalesce(F.get(v, F.floor(F.size(v) / 2).cast("int")).cast("double"), F.lit(0.0))


def normalise(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Positive, different timestamps of each run, in order, with the number of positive ones before repeats went."""
    positive = df.where(F.col(ts) > 0)
    n = positive.groupBy(key).agg(F.count(F.lit(1)).alias("positive_count"))
    return positive.select(key, ts).distinct().join(n, key).withColumn("seq", F.row_number().over(_over(key, ts)) - 1)


def gaps(df: DataFrame, key: str, ts: str, order: str | None = None) -> DataFrame:
    """With ``gap`` to the row before."""
    return df.withColumn("gap", F.col(ts) - F.lag(ts).over(_over(key, order or ts)))


def gap_diagnostics(df: DataFrame, key: str, ts: str, expected: Column, distinct: bool = True, order: str | None = None) -> DataFrame:
    """One row per run: counts, median and largest gap, whether the median is in the band and no gap is a drop.

    ``distinct``: positive different times in order; else the times as they come (``order``), zero included.
    """
    base = df.where(F.col(ts) > 0).select(key, ts).distinct() if distinct else df
    seen = df.groupBy(key).agg(F.count_if(F.col(ts) > 0).alias("positive_count")) if distinct else df.groupBy(key).agg(F.count(F.lit(1)).alias("positive_count"))
    g = gaps(base, key, ts, order).groupBy(key).agg(F.count(F.lit(1)).alias("kept_count"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"))
    return g.join(seen, key).withColumns({
        "in_band": F.coalesce(F.col("median_gap").between(expected * (1 - BAND), expected * (1 + BAND)), F.lit(False)),
        "no_drop": F.coalesce(F.col("max_gap") <= expected * DROP, F.lit(True)),
    })


def gap_summary(df: DataFrame, key: str, ts: str, upper: bool = False) -> DataFrame:
    """interval_count, min, median and max gap and their ratio."""
    g = gaps(df, key, ts).where("gap is not null").groupBy(key)
    out = g.agg(F.count("gap").alias("interval_count"), F.min("gap").alias("min_gap"), (upper_median("gap") if upper else F.median("gap")).alias("median_gap"), F.max("gap").alias("max_gap"))
    return out.withColumn("max_to_median", F.try_divide(F.col("max_gap"), F.col("median_gap")))


def increasing(df: DataFrame, key: str, ts: str, order: str, threshold) -> DataFrame:
    """Whether times strictly increase, whether any gap is in [1, threshold), and the first such gap."""
    near = F.col("gap").between(1, c(threshold) - 1)
    return gaps(df, key, ts, order).groupBy(key).agg(
        F.coalesce(F.bool_and(F.col("gap") > 0), F.lit(True)).alias("strictly_increasing"),
        F.coalesce(F.bool_or(near), F.lit(False)).alias("has_near_duplicate"),
        F.min_by(F.when(near, F.col("gap")), F.when(near, F.col(order))).alias("first_near_gap"),
    )


def islands(df: DataFrame, key: str, order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key: one begins wherever ``starts`` holds (a first row begins one too)."""
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(_over(key, order).rowsBetween(W.unboundedPreceding, 0)))


def near_duplicate_groups(df: DataFrame, key: str, ts: str, threshold, take: int = 16) -> DataFrame:
    """Groups of times closer than ``threshold``: their number, the count that would be left, the first gaps."""
    near = F.col("gap").between(1, c(threshold) - 1)
    g = islands(gaps(df, key, ts), key, ts, ~near)
    size = g.groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"))
    groups = size.groupBy(key).agg(F.count_if(F.col("n") > 1).alias("group_count"), F.count(F.lit(1)).alias("collapsed_count"))
    first = g.where(near).withColumn("rn", F.row_number().over(_over(key, ts))).where(F.col("rn") <= take)
    first = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "gap"))), lambda x: x.gap), ",").alias("first_gaps"))
    return groups.join(first, key, "left").withColumn("first_gaps", F.coalesce("first_gaps", F.lit("")))


def dropped_holes(df: DataFrame, key: str, ts: str, order: str, expected: Column) -> DataFrame:
    """Gaps over DROP times the expected one, with the number of frames that they span (2 at least)."""
    g = gaps(df, key, ts, order).where(F.col("gap") > expected * DROP)
    return g.select(key, order, "gap", F.greatest(F.lit(2), half_up(F.col("gap") / expected)).alias("multiple"))


def hole_agreement(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Whether two series have holes at the same places with the same multiples."""
    x, y = a.select(key, order, F.col("multiple").alias("m1")), b.select(key, order, F.col("multiple").alias("m2"))
    return x.join(y, [key, order], "full").groupBy(key).agg(F.bool_and(F.col("m1").eqNullSafe(F.col("m2"))).alias("holes_agree"), F.count(F.lit(1)).alias("hole_count"))


def longest_run(df: DataFrame, key: str, index: str, usable: str) -> DataFrame:
    """Longest run of usable rows with consecutive indexes."""
    w = _over(key, index)
    g = df.where(F.col(usable)).withColumn("run", F.col(index) - F.row_number().over(w))
    return g.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("longest_run"))


def offset_summary(df: DataFrame, key: str, offset: str) -> DataFrame:
    o = F.col(offset)
    return df.groupBy(key).agg(F.min(o).alias("min_offset"), F.max(o).alias("max_offset"), (F.max(o) - F.min(o)).alias("offset_spread"))


def synthetic_clock(df: DataFrame, key: str, ts: str, tolerance: int = 1) -> DataFrame:
    """SYNTHETIC where all gaps (two at least) are equal within the tolerance."""
    g = gaps(df, key, ts).groupBy(key).agg(F.count("gap").alias("gap_count"), (F.max("gap") - F.min("gap")).alias("gap_spread"))
    return g.withColumn("clock", F.when(F.col("gap_count") < 2, "UNKNOWN").when(F.col("gap_spread") <= tolerance, "SYNTHETIC").otherwise("VARIABLE"))


def burst_summary(df: DataFrame, key: str, ts: str, exposure: str, expected_count: Column) -> DataFrame:
    """One row per burst: span, counts against the expected ones (80 % is the least), exposures, verdict."""
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("callbacks"), F.count_distinct(ts).alias("unique_count"), (F.max(ts) - F.min(ts)).alias("span"),
        F.min(exposure).alias("min_exposure"), F.median(exposure).alias("median_exposure"), F.max(exposure).alias("max_exposure"),
    )
    out = out.withColumns({"expected_count": expected_count.cast("long"), "minimum_count": F.floor(expected_count * 0.8).cast("long")})
    return out.withColumn("proven", F.col("unique_count") >= F.col("minimum_count"))


def running_times(df: DataFrame, key: str, order: str, steps: str, interval) -> DataFrame:
    """Times from whole-frame steps: the sum of all steps so far, times the interval."""
    return df.withColumn("t", F.sum(F.col(steps)).over(_over(key, order).rowsBetween(W.unboundedPreceding, 0)) * c(interval))


def times_from_indexes(df: DataFrame, key: str, index: str, interval) -> DataFrame:
    return df.withColumn("t", (F.col(index) - F.min(index).over(W.partitionBy(key))) * c(interval))


def times_from_pts(df: DataFrame, key: str, pts_ns: str, rebase: bool = True) -> DataFrame:
    first = F.min(pts_ns).over(W.partitionBy(key)) if rebase else F.lit(0)
    return df.withColumn("t", (F.col(pts_ns) - first) / 1e9)


def nominal_times(df: DataFrame, key: str, order: str, interval) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(_over(key, order)) - 1) * c(interval))


def frame_delta_times(df: DataFrame, key: str, order: str, x: str, y: str, interval, least: float = 1e-6) -> DataFrame:
    """Times inferred from displacements: the smallest one is one frame, the others the nearest whole number (1 at least)."""
    w = _over(key, order)
    d = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    out = df.withColumn("displacement", d)
    out = out.withColumn("unit", F.min(F.when(F.col("displacement") > least, F.col("displacement"))).over(W.partitionBy(key)))
    step = F.when(F.col("displacement").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), half_up(F.try_divide(F.col("displacement"), F.col("unit")))))
    return running_times(out.withColumn("steps", step), key, order, "steps", interval)


def partial_times(df: DataFrame, key: str, order: str, x: str, y: str, pts_ns: str, interval=None) -> DataFrame:
    """Times where all rows carry a timestamp (absolute seconds), else from displacement steps.

    The base displacement is the smallest between two timestamped neighbours, else the smallest at all; without an
    ``interval`` that of the first timestamped pair serves. steps are null where timestamps gave the times.
    """
    w, whole = _over(key, order), W.partitionBy(key)
    out = df.withColumns({"d": F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), "dt": (F.col(pts_ns) - F.lag(pts_ns).over(w)) / 1e9})
    out = out.withColumns({
        "base": F.coalesce(F.min(F.when((F.col("d") > 0) & F.col("dt").isNotNull(), F.col("d"))).over(whole), F.min(F.when(F.col("d") > 0, F.col("d"))).over(whole)),
        "interval": c(interval) if interval is not None else F.min(F.col("dt")).over(whole),
        "all_timed": F.min(F.col(pts_ns).isNotNull()).over(whole),
    })
    step = F.when(F.col("d").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), half_up(F.try_divide(F.col("d"), F.col("base")))))
    out = out.withColumn("steps", F.when(~F.col("all_timed"), step))
    inferred = F.sum("steps").over(w.rowsBetween(W.unboundedPreceding, 0)) * F.col("interval")
    return out.withColumn("t", F.when(F.col("all_timed"), F.col(pts_ns) / 1e9).otherwise(inferred)).drop("d", "dt")


def cadence_gate(median_gap, fps, share: float = 0.25) -> Column:
    e = expected_gap_ns(fps)
    return c(median_gap).between(e * (1 - share), e * (1 + share))
