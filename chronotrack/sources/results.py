"""Stored results: load, save, upsert, retention, evidence and log lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrack.functions.text import base_name, compact, key_value_lines

RESULT_SCHEMA = "id string, created_ms long, source_kind string, timing_basis string, frame_count int, detection_count int, assumptions array<string>, mph double, angle double, no_read_reason string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, none where nothing was saved yet; what doesn't fit the schema raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST").parquet(path)


def save(results: DataFrame, path: str) -> None:
    """Replace the stored results: all is written beside them first, then the folders change places. If the job fails, the old rows stay."""
    spark = results.sparkSession
    at = lambda tail="": spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + tail)
    fs = at().getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = f".new-{mark}", f".old-{mark}"
    try:
        results.write.parquet(path.rstrip("/") + new)
        if fs.exists(at()) and not fs.rename(at(), at(old)):
            raise OSError(f"cannot replace {path}")
        if not fs.rename(at(new), at()):
            fs.rename(at(old), at())
            raise OSError(f"cannot replace {path}")
        fs.delete(at(old), True)
    finally:
        fs.delete(at(new), True)


def summary(outcomes: DataFrame, key: str) -> DataFrame:
    """Outcome rows as stored rows: no values with a reason, no reason with values."""
    ok = F.col("status") == "OK"
    return outcomes.select(F.col(key).alias("id"), F.when(ok, F.col("mph")).alias("mph"), F.when(ok, F.col("angle")).alias("angle"), F.when(~ok, F.col("reason")).alias("no_read_reason"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def newest_first(stored: DataFrame, created: str, key: str) -> DataFrame:
    return stored.orderBy(F.desc(created), key)


def retained(files: DataFrame, key: str, newest: list[Column], size: str, most: int = 3, most_bytes: float = 25 * 1024 * 1024) -> DataFrame:
    """Files with ``kept``: the newest ``most`` as long as their sizes fit together; the newest always stays."""
    w = W.partitionBy(key).orderBy(*newest)
    f = files.withColumns({"rank": F.row_number().over(w), "total": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return f.withColumn("kept", (F.col("rank") <= most) & ((F.col("rank") == 1) | (F.col("total") <= most_bytes)))


def evidence(name: Column, basis: Column, mph: Column, angle: Column, reason: Column, note: Column) -> Column:
    """Text evidence of one result; missing values have no line."""
    return key_value_lines([("file", base_name(name)), ("timing", basis), ("mph", F.format_string("%.1f", mph)), ("angle", F.format_string("%.1f", angle)), ("no_read", reason), ("note", compact(note))])


def chunked_lines(df: DataFrame, key: str, values: str, n: int) -> DataFrame:
    """Lines of at most n of a list's values."""
    p = df.select(key, F.posexplode(values).alias("pos", "value")).withColumn("line", F.floor(F.col("pos") / n))
    g = p.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return g.select(key, "line", F.array_join(F.transform("v", lambda x: x.value.cast("string")), ",").alias("text"))
