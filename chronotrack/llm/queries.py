"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrack.llm.exact_dedup import exact_dedup
from chronotrack.llm.language_id import held_out, identify_languages
from chronotrack.llm.license_scan import license_scan
from chronotrack.llm.line_dedup import MIN_SITES, MIN_WORDS, line_dedup
from chronotrack.llm.lm_score import lm_scores
from chronotrack.llm.mixing import mix_sources, mixing_sql
from chronotrack.llm.sentencepiece_scan import encode_digests
from chronotrack.llm.simhash import simhash_components
from chronotrack.llm.toxicity import toxicity
from chronotrack.llm.webp import media_column, media_digest


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark, sf_dir):
    out = license_scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.size("matches").alias("n_matches"), F.array_join("matches.template", ",").alias("templates"), "matches")


def op2_toxicity(spark, sf_dir):
    rest = held_out(F.col("doc_id"), 4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir), labels.where(~rest)).select("doc_id", rest.alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark, sf_dir):
    return encode_digests(documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "n_tokens", "topic", F.round("keep_probability", 9).alias("keep_probability"), "sampled")


def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = identify_languages(docs, train=docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op6_webp(spark, sf_dir):
    return media_digest(media_column(documents(spark, sf_dir)))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op8_lm_score(spark, sf_dir):
    rest = held_out(F.col("doc_id"), 5, 1)
    out = lm_scores(documents(spark, sf_dir), ~rest)
    return out.select("doc_id", rest.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_simhash(spark, sf_dir):
    return simhash_components(documents(spark, sf_dir))


def op10_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_webp": op6_webp,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}

LINE_SQL = f"""
with l as (select doc_id, coalesce('=' || source, 'none') as site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
k as (select *, trim(line, ' ' || chr(9) || chr(13)) as key from l),
b as (select key, min(doc_id) as holder from k where length(key) - length(replace(key, ' ', '')) >= {MIN_WORDS - 1} group by key having count(distinct site) >= {MIN_SITES}),
j as (select k.*, b.holder is not null and k.doc_id is distinct from b.holder as gone from k left join b using (key)),
g as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from j group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::int as n_lines, coalesce(n_removed, 0)::int as n_removed, length(kept) as kept_chars, sha256(kept) as kept_sha256
from documents d left join g using (doc_id)"""

ORACLES = {
    "op4_mixing": mixing_sql(),
    "op7_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from min(doc_id) over g as kept, sha256(t) as text_sha256
from n window g as (partition by t)""",
    "op10_line_dedup": LINE_SQL,
}
