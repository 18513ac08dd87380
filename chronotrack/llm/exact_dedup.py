"""Exact duplicates by 128-bit content hash, smallest id kept, bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._skew import attach
from chronotrack.llm._store import write_table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty. The groups
    are keyed by the MD5 of the text and by the text itself, so equal hashes of different bytes never meet: the hash
    deals the rows out, the comparison of bytes in the aggregate decides. Copies collapse on the map side before the
    shuffle, so a hot group sends one row from each task.

    Ties and repeats: rows that repeat both id and text get the same answer each. A null id is never the smallest; in
    a group of null ids only, keep_id is null and every row is kept. Empty input: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    rows = rows.select("doc_id", "t", F.unhex(F.md5("t")).alias("h"))
    groups = rows.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = write_table(groups.select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "exact-groups")
    narrow = rows.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha"))
    found = attach(narrow, groups, ["h", "sha"], "group_size", F.col("doc_id"))
    return found.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
