"""Removal of lines that spread over many sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._skew import attach
from chronotrack.llm._store import write_table

LG_K = 11
MIN_SITES = 10
MIN_WORDS = 3


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _long_enough(key: Column, min_words: int) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit(" "))) >= min_words - 1


def spread_lines(docs: DataFrame, site_col: str, min_sites: int, min_words: int, lg_k: int) -> DataFrame:
    """h (MD5 of the line), holder (smallest id that has it), n: the lines that occur on at least ``min_sites`` sites.

    ``docs``: doc_id, site, text. One HyperLogLog sketch per line hash is merged by the aggregate. Lines whose estimate
    is within three standard errors of the threshold (one at least) are counted again, exactly; the others are decided
    by their sketch.
    """
    lines = F.transform(F.split("text", "\n"), line_key)
    rows = docs.select("doc_id", "site", F.explode(F.filter(lines, lambda x: _long_enough(x, min_words))).alias("line"))
    rows = rows.select("doc_id", "site", F.unhex(F.md5("line")).alias("h"))
    margin = max(1, math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    sketched = rows.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    seen = write_table(sketched.select("h", "holder", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "line-spread")
    near = seen.where(F.col("sites") <= min_sites + margin)
    exact = attach(rows, near.select("h", "n", F.lit(True).alias("near")), ["h"], "n", F.struct("doc_id", "site")).where("near")
    exact = exact.groupBy("h", "site").agg(F.count(F.lit(1)).alias("x")).groupBy("h").agg(F.count(F.lit(1)).alias("x")).where(F.col("x") >= min_sites)
    far = seen.where(F.col("sites") > min_sites + margin)
    return write_table(far.select("h", "holder", "n").union(near.join(exact, "h", "left_semi").select("h", "holder", "n")), "boilerplate")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and n_lines, n_removed.

    A line (blanks around it trimmed) with at least ``min_words`` words that occurs on ``min_sites`` or more different
    sites stays only in the document with the smallest id that has it; so no content goes altogether, and the first of
    a group of copies stays whole. Other lines, their order and their blanks are untouched.

    Null text stays null with 0 lines; an empty text has one empty line. A null site counts as one site of its own.
    Rows that repeat an id share its decision. A null id is never the holder unless all are null. Empty input: no rows.
    Columns named n_lines or n_removed in ``docs`` are replaced; all others pass through.
    """
    docs = docs.drop("n_lines", "n_removed")
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("none")) if site_col in docs.columns else F.lit("none")
    slim = docs.select(F.col(id_col).alias("doc_id"), site.alias("site"), F.col(text_col).cast("string").alias("text"))
    boiler = spread_lines(slim, site_col, min_sites, min_words, lg_k)
    lines = F.transform(F.split("text", "\n"), line_key)
    rows = slim.select("doc_id", F.explode(F.filter(lines, lambda x: _long_enough(x, min_words))).alias("line")).select("doc_id", F.unhex(F.md5("line")).alias("h"))
    hits = attach(rows, boiler.withColumn("spread", F.lit(True)), ["h"], "n", F.col("doc_id")).where("spread").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    hits = hits.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("h").alias("__gone"))
    found = docs.join(hits, F.col(id_col).eqNullSafe(F.col("__id")), "left")
    parts = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.filter(parts, lambda x: ~(_long_enough(line_key(x), min_words) & F.array_contains(F.col("__gone"), F.unhex(F.md5(line_key(x))))))
    changed = F.when(F.col("__gone").isNull(), parts).otherwise(kept)
    found = found.withColumn("__kept", changed).withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)))
    found = found.withColumn("n_removed", F.col("n_lines") - F.coalesce(F.size("__kept"), F.lit(0)))
    return found.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))).drop("__id", "__gone", "__kept")
