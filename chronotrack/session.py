"""Session helper for local work and tests; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the queries rely on: UTC, ANSI (the default), AQE."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("chronotrack").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reused(df: DataFrame) -> DataFrame:
    """A result of Python kernels that several branches of a plan read: computed once, kept in memory or on disk.

    Lost parts are computed again from their lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
