"""Training-corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrack.llm._store import write_table
from chronotrack.llm.language_id import UNDECIDED, identify_languages
from chronotrack.llm.line_dedup import line_dedup
from chronotrack.llm.mixing import mix_sources
from chronotrack.llm.near_dedup import near_components
from chronotrack.llm.sentencepiece_scan import encode_documents

#: Least share of the best language; below it a text belongs to none.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, no clear winner) go; a missing lang is filled in."""
    found = identify_languages(docs).where((F.col("lang_pred") != UNDECIDED) & (F.col("score") >= LEAST_SHARE))
    found = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("lang_pred").alias("__lang"))
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur on many sites stay in one document only; n_chars follows."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest id."""
    found = near_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities raked to the source, language and topic marginals stay."""
    return mix_sources(docs).where("sampled").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each kept document."""
    return encode_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_spread), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", encode)]

#: SQL can express neither the language model nor the best segmentation; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
