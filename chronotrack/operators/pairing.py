"""Joins of two clocks: positional, exact, constant offset, nearest, tolerance, monotone; offset candidates; interval joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.numeric import c



def numbered(df: DataFrame, key: str, order: str, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(order)))


def positional(a: DataFrame, b: DataFrame, key: str, at: str, bt: str) -> DataFrame:
    """i-th row of one clock with the i-th of the other, for runs whose counts are equal; ``rel`` counts from the first b."""
    x, y = numbered(a.select(key, F.col(at).alias("a_ts")), key, "a_ts"), numbered(b.select(key, F.col(bt).alias("b_ts")), key, "b_ts")
    n = x.groupBy(key).agg(F.count(F.lit(1)).alias("na")).join(y.groupBy(key).agg(F.count(F.lit(1)).alias("nb")), key).where("na = nb").select(key)
    pairs = x.join(n, key, "left_semi").join(y, [key, "rn"])
    return pairs.withColumn("rel", F.col("b_ts") - F.min("b_ts").over(W.partitionBy(key)))


def membership(a: DataFrame, b: DataFrame, key: str, at: str, bt: str) -> DataFrame:
    """Rows of a with whether their time is one of b's."""
    times = b.select(key, F.col(bt).alias(at)).distinct().withColumn("hit", F.lit(True))
    return a.join(times, [key, at], "left").withColumn("matched", F.col("hit").isNotNull()).drop("hit")


def unmatched_edges(a: DataFrame, b: DataFrame, key: str, at: str, bt: str) -> DataFrame:
    """Unmatched rows before the first match, after the last and between; a pairing may lose one at each end, none inside."""
    m = numbered(membership(a, b, key, at, bt), key, at)
    w = W.partitionBy(key)
    m = m.withColumns({"first_hit": F.min(F.when(F.col("matched"), F.col("rn"))).over(w), "last_hit": F.max(F.when(F.col("matched"), F.col("rn"))).over(w)})
    out = m.groupBy(key).agg(
        F.count_if(F.col("matched")).alias("matched_count"),
        F.count_if(F.col("first_hit").isNull() | (F.col("rn") < F.col("first_hit"))).alias("leading"),
        F.count_if(F.col("rn") > F.col("last_hit")).alias("trailing"),
        F.count_if(~F.col("matched") & F.col("rn").between(F.col("first_hit"), F.col("last_hit"))).alias("interior"),
    )
    verdict = F.when(F.col("matched_count") == 0, "NO_MATCH").when(F.col("interior") > 0, "INTERIOR_UNMATCHED").when((F.col("leading") > 1) | (F.col("trailing") > 1), "EDGE_UNMATCHED").otherwise("PAIRED")
    return out.withColumn("verdict", verdict)


def constant_offset(a: DataFrame, b: DataFrame, key: str, at: str, bt: str, limit: int, frame_gap) -> DataFrame:
    """Runs whose i-th times all differ by one offset: EXACT for none, EQUIVALENT below the limit, AMBIGUOUS near whole frames."""
    p = positional(a, b, key, at, bt).groupBy(key).agg(F.min(F.col("b_ts") - F.col("a_ts")).alias("offset"), F.max(F.col("b_ts") - F.col("a_ts")).alias("most"), F.count(F.lit(1)).alias("pairs"))
    o = F.abs(F.col("offset"))
    verdict = F.when(F.col("offset") != F.col("most"), "VARIABLE").when(o == 0, "EXACT").when(whole_frame_ambiguous(F.col("offset"), frame_gap), "AMBIGUOUS").when(o < limit, "EQUIVALENT").otherwise("TOO_FAR")
    return p.select(key, "pairs", "offset", verdict.alias("verdict"))


def whole_frame_ambiguous(offset, gap, tolerance: int = 1000) -> Column:
    """Whether an offset of half a frame or more lies within the tolerance of a whole number of frames."""
    o, g = F.abs(c(offset)), c(gap)
    r = F.pmod(o, g)
    return (o >= F.floor(g / 2)) & (F.least(r, g - r) <= tolerance)


def nearest(a: DataFrame, b: DataFrame, key: str, at: str, bt: str) -> DataFrame:
    """For each row of a the nearest time of b of the same key; of two as near the smaller one. Null where b has none.

    Both sides are put in one order by key and time; the last b before and the first b after each a are found by
    windows, so no pairs are made.
    """
    left = a.withColumns({"__t": F.col(at), "__b": F.lit(None).cast(b.schema[bt].dataType), "__a": F.lit(True)})
    right = b.select(key, F.col(bt).alias("__t"), F.col(bt).alias("__b"), F.lit(False).alias("__a"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = W.partitionBy(key).orderBy("__t", "__a")
    before = F.last("__b", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("__b", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    both = both.withColumns({"__p": before, "__n": after}).where("__a")
    pick = F.when(F.col("__p").isNull(), F.col("__n")).when(F.col("__n").isNull(), F.col("__p")).when(F.col("__t") - F.col("__p") <= F.col("__n") - F.col("__t"), F.col("__p")).otherwise(F.col("__n"))
    return both.withColumn("nearest", pick).withColumn("distance", F.abs(F.col("__t") - pick)).drop("__t", "__b", "__a", "__p", "__n")


def tolerance_candidates(a: DataFrame, b: DataFrame, key: str, at: str, bt: str, tolerance: int) -> DataFrame:
    """All (a, b) within the tolerance: an equi join on time cells of twice that width, so a hot key is dealt over its cells."""
    width = 2 * tolerance + 1
    x = a.withColumn("__c", F.explode(F.sequence(F.floor((F.col(at) - tolerance) / width), F.floor((F.col(at) + tolerance) / width))))
    y = b.select(key, F.col(bt).alias("b_ts")).withColumn("__c", F.floor(F.col("b_ts") / width))
    return x.join(y, [key, "__c"]).where(F.abs(F.col("b_ts") - F.col(at)) <= tolerance).drop("__c")


def offset_candidates(a: DataFrame, b: DataFrame, key: str, at: str, bt: str) -> DataFrame:
    """All different offsets b - a of a run: as many as a run's rows squared, so runs are meant to be short."""
    return a.select(key, at).join(b.select(key, bt), key).select(key, (F.col(bt) - F.col(at)).alias("offset")).distinct()


def base_offsets(a: DataFrame, b: DataFrame, key: str, at: str, bt: str, edge: int = 3) -> DataFrame:
    """Bounded offsets with where they come from: the first a with the first b's, the last a with the last b's."""
    first, last = lambda t: W.partitionBy(key).orderBy(t), lambda t: W.partitionBy(key).orderBy(F.desc(t))
    out = []
    for name, w in (("first", first), ("last", last)):
        x = a.withColumn("rn", F.row_number().over(w(at))).where("rn = 1").select(key, F.col(at).alias("a_ts"))
        y = b.withColumn("rn", F.row_number().over(w(bt))).where(F.col("rn") <= edge).select(key, F.col(bt).alias("b_ts"))
        out.append(x.join(y, key).select(key, (F.col("b_ts") - F.col("a_ts")).alias("offset"), F.lit(name).alias("source")))
    return out[0].union(out[1]).distinct()


def expand_offsets(base: DataFrame, key: str, shifts: tuple[int, int], gap: int) -> DataFrame:
    """Offsets moved by whole frames, equal ones once with all their sources in order."""
    out = base.withColumn("shift", F.explode(F.sequence(F.lit(shifts[0]), F.lit(shifts[1]))))
    out = out.select(key, (F.col("offset") + F.col("shift") * gap).alias("offset"), F.format_string("%s%+d", "source", "shift").alias("source"))
    return out.groupBy(key, "offset").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def interval_join(events: DataFrame, frames: DataFrame, key: str, start: Column, end: Column, at: str) -> DataFrame:
    """Frames between each event's bounds, inclusive."""
    e = events.withColumns({"__s": start, "__e": end})
    return e.join(frames, key).where(F.col(at).between(F.col("__s"), F.col("__e"))).drop("__s", "__e")


def lookup(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """a with the row of b of the same key; of several the last by ``order``."""
    last = b.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn", order)
    return a.join(last, key)


def verified_zip(a: DataFrame, b: DataFrame, key: str, order: str, same: Column) -> DataFrame:
    """Whether two sequences have rows at the same places and ``same`` (over columns a_*, b_*) holds for all."""
    x = a.select(key, order, *[F.col(k).alias(f"a_{k}") for k in a.columns if k not in (key, order)], F.lit(True).alias("__a"))
    y = b.select(key, order, *[F.col(k).alias(f"b_{k}") for k in b.columns if k not in (key, order)], F.lit(True).alias("__b"))
    both = x.join(y, [key, order], "full")
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.coalesce(same, F.lit(False))).alias("verified"))


# --- folds in time order, per run


def greedy_matches(pts: np.ndarray, sensor: np.ndarray, offset: int, tolerance: int) -> list[tuple[int, int, int, bool]]:
    """(frame, sensor, residual, ambiguous) of each pts that has a sensor time within the tolerance and behind the last one used."""
    out, used = [], 0
    for i, p in enumerate(pts + offset):
        lo = max(used, int(np.searchsorted(sensor, p - tolerance)))
        hi = int(np.searchsorted(sensor, p + tolerance, "right"))
        if lo >= hi:
            continue
        d = np.abs(sensor[lo:hi] - p)
        k = lo + int(d.argmin())
        out.append((i, k, int(sensor[k] - p), hi - lo > 1))
        used = k + 1
    return out


def value_match(pts: DataFrame, sensor: DataFrame, key: str, at: str, bt: str, tolerance: int, least_run: int) -> DataFrame:
    """Best offset of each run by value matching, and the verdict.

    Every difference of the run's first and other times is tried; the best has most matches, most unambiguous ones, the
    longest clean run, then the smallest largest, median and summed residual, then the smallest offset.
    """
    schema = f"{key} {pts.schema[key].dataType.simpleString()}, offset long, matched int, ambiguous int, clean_run int, max_residual long, verdict string"

    def match(k, a, b):
        x, y = np.sort(a[at].to_numpy(np.int64)), np.sort(b[bt].to_numpy(np.int64))
        best = None
        for o in np.unique(y[None, :] - x[:, None]).tolist() if len(x) and len(y) else []:
            m = greedy_matches(x, y, o, tolerance)
            if not m:
                continue
            clean = [i for i, _, _, bad in m if not bad]
            run = top = 0
            for j, i in enumerate(clean):
                run = run + 1 if j and i == clean[j - 1] + 1 else 1
                top = max(top, run)
            r = sorted(abs(d) for _, _, d, _ in m)
            middle = r[len(r) // 2] if len(r) % 2 else (r[len(r) // 2 - 1] + r[len(r) // 2]) // 2
            rank = (len(m), len(clean), top, -r[-1], -middle, -sum(r), -abs(o))
            if best is None or rank > best[0]:
                best = rank, o, m, top, r[-1]
        if best is None:
            return pd.DataFrame([[k[0], None, 0, 0, 0, None, "NO_MATCH"]], columns=[key, "offset", "matched", "ambiguous", "clean_run", "max_residual", "verdict"])
        _, o, m, run, worst = best
        bad = sum(x[3] for x in m)
        verdict = "AMBIGUOUS_MATCH" if bad else "UNIQUE_MATCH" if len(m) == len(x) and run >= least_run else "PARTIAL_MATCH"
        return pd.DataFrame([[k[0], o, len(m), bad, run, worst, verdict]], columns=[key, "offset", "matched", "ambiguous", "clean_run", "max_residual", "verdict"])

    return pts.select(key, at).groupBy(key).cogroup(sensor.select(key, bt).groupBy(key)).applyInPandas(match, schema)


def monotone_matches(pts: np.ndarray, sensor: np.ndarray, offset: int) -> np.ndarray:
    """Nearest sensor of each pts by a cursor that moves on while the next one is as near."""
    out, k = np.zeros(len(pts), np.int64), 0
    for i, p in enumerate(pts + offset):
        while k + 1 < len(sensor) and abs(sensor[k + 1] - p) <= abs(sensor[k] - p):
            k += 1
        out[i] = k
    return out


def anchor_mappings(pts: DataFrame, sensor: DataFrame, offsets: DataFrame, key: str, at: str, bt: str, most: int, middle: int) -> DataFrame:
    """Each offset's mapping: residuals and the first gate that rejects it (null: it survives)."""
    k_type = pts.schema[key].dataType.simpleString()
    schema = f"{key} {k_type}, offset long, max_residual long, median_residual long, mapping array<long>, reason string"
    offs = offsets.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_set("offset")).alias("offsets"))
    own = pts.select(F.col(key).alias("__p"), at)
    merged = own.join(offs, F.col("__p") == F.col("__k")).select(F.col("__p").alias(key), at, "offsets")

    def fold(k, a, b):
        x, y = np.sort(a[at].to_numpy(np.int64)), np.sort(b[bt].to_numpy(np.int64))
        rows = []
        for o in a["offsets"].iloc[0] if len(a) and len(y) else []:
            m = monotone_matches(x, y, int(o))
            r = np.abs(y[m] - (x + int(o)))
            s = np.sort(r)
            mid = int(s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) // 2)
            reason = "TOO_FEW" if len(x) < 3 else "NOT_ONE_TO_ONE" if len(np.unique(m)) < len(m) else "MAX_RESIDUAL" if r.max() > most else "MEDIAN_RESIDUAL" if mid > middle else None
            rows.append([k[0], int(o), int(r.max()), mid, m.tolist(), reason])
        return pd.DataFrame(rows, columns=[key, "offset", "max_residual", "median_residual", "mapping", "reason"])

    return merged.groupBy(key).cogroup(sensor.select(key, bt).groupBy(key)).applyInPandas(fold, schema)


def surviving_mappings(mappings: DataFrame, key: str) -> DataFrame:
    """Different surviving mappings, each by its best offset, and the run's verdict."""
    best = F.min_by(F.struct("offset", "max_residual", "median_residual"), F.struct("max_residual", "median_residual", F.abs("offset"), "offset"))
    kept = mappings.where("reason is null").groupBy(key, "mapping").agg(best.alias("b")).select(key, "b.*")
    n = kept.groupBy(key).agg(F.count(F.lit(1)).alias("survivors"), F.min_by("offset", F.struct("max_residual", "median_residual", "offset")).alias("offset"))
    everything = mappings.groupBy(key).agg(F.count(F.lit(1)).alias("tried"), F.min("reason").alias("some_reason"))
    verdict = F.when(F.coalesce("survivors", F.lit(0)) == 0, F.coalesce("some_reason", F.lit("NO_CANDIDATE"))).when(F.col("survivors") == 1, "UNIQUE_ANCHOR").otherwise("AMBIGUOUS_ANCHOR")
    return everything.join(n, key, "left").select(key, "tried", F.coalesce("survivors", F.lit(0)).alias("survivors"), "offset", verdict.alias("verdict"))


