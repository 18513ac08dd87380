"""Join rows to per-group values when a few groups may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group with at least 1 / HOT_PARTS of all rows is hot: fewer than HOT_PARTS + 1 groups can be, which bounds the broadcast.
HOT_PARTS = 1000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per key, ``size`` rows each; best a written table).

    Hot groups are broadcast (at most HOT_PARTS rows); their rows then take part in the shuffle only under a salted
    key that matches nothing, so they are dealt evenly. All other groups meet their rows by an ordinary shuffle join.
    ``spread``: a column of ``rows`` that differs between rows of a group. Null keys match nothing.
    """
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(2, -(-total // HOT_PARTS))
    hot = groups.where(F.col(size) >= least).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values])
    rest = groups.where(F.col(size) < least).withColumn("__salt", F.lit(-1))
    rows = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.col(f"__hot_{size}").isNotNull()
    rows = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")).otherwise(F.lit(-1)))
    found = rows.join(rest, [*keys, "__salt"], "left")
    for c in values:
        found = found.withColumn(c, F.coalesce(f"__hot_{c}", c))
    return found.drop("__salt", *[f"__hot_{c}" for c in values])
