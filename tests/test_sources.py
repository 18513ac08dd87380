"""Stored results, retention, coordinates and colours."""

import pytest
from pyspark.sql import functions as F

from chronotrack.functions import colour as C
from chronotrack.functions import numeric as N
from chronotrack.functions import text as T
from chronotrack.sources import results as R


def test_store(spark, tmp_path):
    path = str(tmp_path / "results")
    assert R.load(spark, path).count() == 0
    row = ("a", 1, "import", "real", 5, 4, ["planar"], 60.0, 10.0, None)
    R.save(spark.createDataFrame([row], R.RESULT_SCHEMA), path)
    assert R.load(spark, path).first().mph == 60.0
    new = spark.createDataFrame([("a", 2, "import", "real", 5, 4, ["planar"], None, None, "JUMP"), ("b", 3, "import", "real", 5, 4, ["planar"], 1.0, 2.0, None)], R.RESULT_SCHEMA)
    both = R.upsert(R.load(spark, path), new, "id")
    assert [(r.id, r.no_read_reason) for r in R.newest_first(both, "created_ms", "id").collect()] == [("b", None), ("a", "JUMP")]
    assert R.delete(both, spark.createDataFrame([("a",)], "id string"), "id").count() == 1


def test_retention_keeps_one(spark):
    f = spark.createDataFrame([("d", 1, 5.0), ("d", 2, 50.0)], "d string, at int, size double")
    r = {x.at: x.kept for x in R.retained(f, "d", [F.desc("at")], "size", 3, 25.0).collect()}
    assert r == {2: True, 1: False}


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(N.normalise_signed_degrees(F.lit(190.0))).first()[0] == pytest.approx(-170)
    assert one.select(N.normalise_signed_degrees(F.lit(-180.0))).first()[0] == pytest.approx(180)
    assert [one.select(f(F.lit(2.5))).first()[0] for f in (N.half_up, N.half_even)] == [3, 2]
    assert one.select(N.sample_to_elapsed_ns(F.lit(220), F.lit(100), F.lit(10**9), F.lit(48000))).first()[0] == 10**9 + 120 * 10**9 // 48000
    assert one.select(*N.impact_window(F.lit(250_000), F.lit(120), F.lit(8_000_000))).first()[:] == (0, 1_250_000, 30, 1)
    h = one.select(*C.hsv(F.lit(-65536))).first()
    assert h[:] == (0.0, 1.0, 1.0)
    assert one.select(T.positive_feet(F.lit(" 2.5 "))).first()[0] == 2.5
    assert one.select(T.positive_feet(F.lit("nan"))).first()[0] is None


def test_failed_save_keeps_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.createDataFrame([("a", 1)], "id string, created_ms long").selectExpr("id", "created_ms", *[f"cast(null as {t}) as {c}" for c, t in (x.strip().split(" ") for x in R.RESULT_SCHEMA.split(",")[2:])])
    R.save(rows, path)
    with pytest.raises(Exception, match="broken"):
        R.save(rows.withColumn("id", F.raise_error(F.lit("broken"))), path)
    assert [r.id for r in R.load(spark, path).collect()] == ["a"]
    R.save(R.upsert(R.load(spark, path), rows.withColumn("id", F.lit("b")), "id"), path)
    assert {r.id for r in R.load(spark, path).collect()} == {"a", "b"}
    assert [p.name for p in tmp_path.iterdir()] == ["store"]
