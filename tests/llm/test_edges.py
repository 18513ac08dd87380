"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronotrack.llm.exact_dedup import exact_dedup
from chronotrack.llm.language_id import identify_languages
from chronotrack.llm.license_scan import license_scan
from chronotrack.llm.line_dedup import line_dedup
from chronotrack.llm.lm_score import lm_scores
from chronotrack.llm.mixing import mix_sources
from chronotrack.llm.sentencepiece_scan import decode_documents, digest, encode_documents
from chronotrack.llm.simhash import simhash_components
from chronotrack.llm.toxicity import toxicity
from chronotrack.llm.webp import media_column, media_digest


def labels(spark, ids):
    return spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")


OPERATORS = {
    "license": lambda s, d: license_scan(d), "toxicity": lambda s, d: toxicity(d, labels(s, range(9))), "toxicity_unlabelled": lambda s, d: toxicity(d, labels(s, [])), "pieces": lambda s, d: digest(encode_documents(d, chunk=5000)),
    "mixing": lambda s, d: mix_sources(d), "language": lambda s, d: identify_languages(d), "language_untaught": lambda s, d: identify_languages(d, train=d.where("1 = 0")), "webp": lambda s, d: media_digest(media_column(d)),
    "exact": lambda s, d: exact_dedup(d), "lm": lambda s, d: lm_scores(d, F.col("doc_id") % 2 == 0), "simhash": lambda s, d: simhash_components(d), "lines": lambda s, d: line_dedup(d, min_sites=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, edges, name):
    assert OPERATORS[name](spark, edges).count() == edges.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).count() == 0


def test_defined_results(spark, edges):
    r = {x.doc_id: x for x in identify_languages(edges).collect()}
    assert (r[1].lang_pred, r[2].lang_pred, r[5].lang_pred, r[6].lang_pred) == ("und",) * 4
    back = {x.doc_id: x.text for x in decode_documents(encode_documents(edges, chunk=5000)).collect()}
    assert back[7] == "▁ 漢字  é𓀀\r\n end" and back[1] == back[2] == "" and back[3] == "word " * 20000
    f = {x.doc_id: x for x in simhash_components(edges).collect()}
    assert f[1].fingerprint == f[2].fingerprint == "0" * 16 and f[5].component_id == 1
    assert f[None].component_id == 8
    m = {x.doc_id: x for x in media_digest(media_column(edges)).collect()}
    assert m[1].payload_bytes == m[2].payload_bytes == 64 and m[1].media_sha256 == m[2].media_sha256
    e = exact_dedup(edges).where("doc_id = 3").collect()
    assert [(x.keep_id, x.group_size, x.kept) for x in e] == [(3, 2, True)] * 2


@pytest.mark.parametrize("step", range(5))
def test_stages(spark, docs, edges, nothing, step):
    name, stage = corpus_pipeline.STAGES[step]
    for d in (docs, edges, nothing):
        out = stage(spark, d, "")
        assert step == 4 or out.columns == d.columns
        assert out.count() <= d.count()


def test_stage_decisions(spark, docs, edges):
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, edges, "").collect()}
    assert not kept & {1, 2, 5, 6} and {3, 7, 8} <= kept
    assert corpus_pipeline.language_id(spark, docs, "").count() == docs.count()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert 5 in kept and not kept & {11, 12}
