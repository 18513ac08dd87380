"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._store import write_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for each node of ``edges`` (a, b: long).

    Alternating star contraction: each round links neighbours to their smallest neighbour, first the larger ones,
    then the smaller ones, until every node hangs on its component's smallest node. Each round is written to the shared
    folder; only two numbers (edge count and checksum) come to the driver. Self loops and repeats are allowed.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = write_table(ends, "edges")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).distinct()
        mark = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b")
        now = write_table(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    raise RuntimeError("components did not settle")
