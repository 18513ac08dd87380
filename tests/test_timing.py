"""Golden values of clock diagnostics and pairing."""

import pytest
from pyspark.sql import functions as F

from chronotrack.operators import pairing as P
from chronotrack.operators import timing as G


def ts(spark, values, col="ts"):
    return spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], f"run string, i int, {col} long")


def test_normalise(spark):
    r = G.normalise(ts(spark, [-5, 0, 10, 20]), "run", "ts").orderBy("seq").collect()
    assert [x.ts for x in r] == [10, 20] and r[0].positive_count == 2
    r = G.normalise(ts(spark, [30, 10, 30, 20, 10]), "run", "ts").orderBy("seq").collect()
    assert [x.ts for x in r] == [10, 20, 30] and r[0].positive_count == 5


def test_gap_diagnostics(spark):
    d = G.gap_diagnostics(ts(spark, [1, 8_330_001, 16_660_001, 33_320_001, 41_650_001]), "run", "ts", F.lit(8_333_333.0)).first()
    assert (d.median_gap, d.max_gap, d.in_band, d.no_drop) == (8_330_000, 16_660_000, True, False)


def test_ordered_keeps_zero(spark):
    d = G.gap_diagnostics(ts(spark, [0, 16_666_000, 24_999_000, 33_332_000]), "run", "ts", F.lit(8_333_333.0), distinct=False, order="i").first()
    assert (d.kept_count, d.max_gap, d.no_drop) == (4, 16_666_000, False)


def test_three_medians(spark):
    r = ts(spark, [1, 2, 3, 4]).groupBy("run").agg(F.median("ts").alias("a"), G.median_long("ts").alias("b"), G.upper_median("ts").alias("c")).first()
    assert (r.a, r.b, r.c) == (2.5, 2, 3)


def test_near_duplicates(spark):
    r = G.near_duplicate_groups(ts(spark, [1000, 1001, 8_333_000, 16_666_000]), "run", "ts", 100).first()
    assert (r.group_count, r.collapsed_count, r.first_gaps) == (1, 3, "1")


def test_positional(spark):
    a, b = ts(spark, [0, 8, 16, 25], "a"), ts(spark, [100, 108, 116, 125], "b")
    r = P.positional(a, b, "run", "a", "b").orderBy("rn").collect()
    assert [x.rel for x in r] == [0, 8, 16, 25]
    assert P.positional(a, ts(spark, [1], "b"), "run", "a", "b").count() == 0


PTS = [0, 8333, 16666, 24999]


def test_value_match_unique(spark):
    r = P.value_match(ts(spark, PTS, "a"), ts(spark, [1_000_000 + v for v in (*PTS, 33332)], "b"), "run", "a", "b", 750, 4).first()
    assert (r.verdict, r.offset, r.matched, r.clean_run, r.max_residual) == ("UNIQUE_MATCH", 1_000_000, 4, 4, 0)


def test_value_match_partial_and_ambiguous(spark):
    r = P.value_match(ts(spark, PTS, "a"), ts(spark, [100_000, 200_000, 300_000], "b"), "run", "a", "b", 10, 4).first()
    assert r.verdict == "PARTIAL_MATCH" and r.matched < 3
    r = P.value_match(ts(spark, PTS[:3], "a"), ts(spark, [1_000_000, 1_000_001, 1_008_333, 1_016_666], "b"), "run", "a", "b", 10, 3).first()
    assert (r.verdict, r.matched, r.ambiguous) == ("AMBIGUOUS_MATCH", 3, 1)


def test_nearest_takes_the_smaller_of_ties(spark):
    r = P.nearest(ts(spark, [10, 15, 99], "a"), ts(spark, [5, 20], "b"), "run", "a", "b").orderBy("a").collect()
    assert [(x.nearest, x.distance) for x in r] == [(5, 5), (20, 5), (20, 79)]
    r = P.nearest(ts(spark, [10], "a"), ts(spark, [5, 15], "b"), "run", "a", "b").first()
    assert r.nearest == 5


def test_edges(spark):
    a, b = ts(spark, [1, 2, 3, 4, 5], "a"), ts(spark, [2, 3, 5], "b")
    r = P.unmatched_edges(a, b, "run", "a", "b").first()
    assert (r.leading, r.trailing, r.interior, r.verdict) == (1, 0, 1, "INTERIOR_UNMATCHED")


def test_anchor(spark):
    a, b = ts(spark, PTS, "a"), ts(spark, [1_000_000 + v for v in PTS], "b")
    off = P.expand_offsets(P.base_offsets(a, b, "run", "a", "b"), "run", (-1, 1), 8333)
    got = {r.offset for r in off.collect()}
    assert {1_000_000, 1_008_333, 991_667} <= got
    assert P.surviving_mappings(P.anchor_mappings(a, b, off, "run", "a", "b", 100, 50), "run").first().verdict == "UNIQUE_ANCHOR"


def test_partial_times(spark):
    rows = [("r", 0, 0.0, 0), ("r", 1, 3.0, 10_000_000), ("r", 2, 18.0, None), ("r", 3, 21.2, None)]
    df = spark.createDataFrame(rows, "run string, i int, x double, pts long").withColumn("y", F.lit(0.0))
    r = G.partial_times(df, "run", "i", "x", "y", "pts").orderBy("i").collect()
    assert [x.t for x in r] == pytest.approx([0, 0.01, 0.06, 0.07])
    assert [x.steps for x in r][1:] == [1, 5, 1]


def test_index_times(spark):
    df = spark.createDataFrame([("r", i) for i in (40, 43, 46, 49)], "run string, i int")
    assert [x.t for x in G.times_from_indexes(df, "run", "i", F.lit(1 / 120)).orderBy("i").collect()] == pytest.approx([0, 3 / 120, 6 / 120, 9 / 120])
