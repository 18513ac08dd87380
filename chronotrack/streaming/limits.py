"""Time limits on actions: the driver cancels the jobs of an action that takes too long."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")


class TimedOut(RuntimeError):
    """The action was cancelled."""


def with_timeout(spark: SparkSession, seconds: float, action: Callable[[], R]) -> R:
    """The result of ``action``; after ``seconds`` its Spark jobs are cancelled and TimedOut is raised."""
    sc, tag, late = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
