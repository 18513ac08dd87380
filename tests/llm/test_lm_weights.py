"""op8: starting weights are learned from the decisions of all training rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotrack.llm import lm_score as M
from tests.llm.conftest import prose

ODD = [None, "", " \t", "a", " A  b\n", "É x", "x y \x0b\x0c\r z", "▁ 漢字"]


def test_split_gives_the_words_of_each_text():
    flat, size = M.split(pa.array(ODD).slice(1))
    assert size.tolist() == [len(M.words(t)) for t in ODD[1:]]
    assert flat.to_pylist() == M.listed(flat) == [w for t in ODD[1:] for w in M.words(t)]
    assert M.split(pa.array(ODD))[1][0] == 0 and M.listed(pa.array([], pa.binary())) == []


def test_histogram_counts_each_decision_without_itself():
    rng = np.random.default_rng(4)
    code = M.Code(np.array([50, 20, 9, 4, 2], np.int64))
    contexts, symbols = [rng.integers(0, 40, 300).astype(np.uint32) for _ in range(2)], rng.integers(0, 5, 300)
    counts = np.zeros((2, 1 << 8, 2), np.int32)
    M.tally(contexts, code, symbols, 8, counts)
    p = M.Predictors(code, counts, 8)
    how, want = p.binned(M.WORD_LEVELS), {}
    at, node, bit = code.expand(symbols)
    for i, v, b in zip(at.tolist(), node.tolist(), bit.tolist()):
        cell, shift = int(M._level(p.zero[v : v + 1], 5)[0]) << 1 | b, 6
        for k, c in enumerate(contexts):
            n = counts[k][M._slot(c[i : i + 1], np.array([v]), 8)[0]].astype(int)
            n[b] -= 1
            level = int((max(-8, min(8, math.log((n[1] + M.DELTA) / (n[0] + M.DELTA)))) + 8) * 2)
            cell |= (min(31, level) | sum(n.sum() > x for x in (0, 2, 15)) << 5) << shift
            shift += 7
        want[cell] = want.get(cell, 0) + 1
    got = p.histogram(how, contexts, symbols)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want
    assert np.array_equal(got, sum(p.histogram(how, [c[a : a + 50] for c in contexts], symbols[a : a + 50]) for a in range(0, 300, 50)))


def test_starting_weights_see_all_training_rows(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, prose(rng, [f"w{k}" for k in range(50)], 12)) for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    seen, plain = [], M.Predictors.fit

    def fit(self, how, cells, times):
        seen.append((int(times.sum()), self.code, plain(self, how, cells, times)))
        return seen[-1][2]

    monkeypatch.setattr(M.Predictors, "fit", fit)
    some = docs.where("doc_id < 1400")
    scores = [{r.doc_id: r.score for r in M.lm_scores(docs.repartition(n), F.col("doc_id") < 1400).collect()} for n in (1, 5)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-3)
    assert np.array_equal(seen[0][2], seen[2][2]) and np.array_equal(seen[1][2], seen[3][2]), "partitions change no weight"
    n = {r.word: r.n for r in M.count_words(some).collect()}
    known = sorted(((w, k) for w, k in n.items() if w != M.END), key=lambda x: (-x[1], x[0]))
    code = seen[0][1]
    assert all(k > 1 for _, k in known) and len(code.size) == len(known) + 2
    assert seen[0][0] == sum(int(code.size[i]) * k for i, (_, k) in enumerate(known)) + int(code.size[-1]) * n[M.END]


def test_parts_that_are_scored_apart_are_looked_up_together(monkeypatch):
    texts = [prose(random.Random(k), [f"w{i}" for i in range(60)], 3 + k % 9) for k in range(40)] + ODD
    n = np.arange(30, 0, -1)
    code = M.Code(np.concatenate((n, [5, 40])))
    m = M.Model(pa.array([f"w{i}".encode() for i in range(30)], pa.binary()), n, 600, 61, 40, code)
    rng = np.random.default_rng(5)
    m.word = M.Predictors(code, rng.integers(0, 9, (2, 1 << M.WORD_BITS, 2)).astype(np.int32), M.WORD_BITS)
    m.spell = M.Predictors(M.spell_code(), rng.integers(0, 9, (4, 1 << M.SPELL_BITS, 2)).astype(np.int32), M.SPELL_BITS)
    calls, find = [], M.Model.find
    monkeypatch.setattr(M.Model, "find", lambda self, flat: calls.append(len(flat)) or find(self, flat))
    monkeypatch.setattr(M, "TOGETHER", 100)
    batch = pa.record_batch([pa.array(texts)], names=["text"]).slice(1)
    got = list(M.looked_up(m, [batch], 0))
    assert len(got) > 5 and calls == [sum(len(M.words(t)) for t in texts[1:])]
    assert sum((part.column(0).to_pylist() for part, *_ in got), []) == texts[1:]
    for part, flat, size, symbols in got:
        a, b = m.score(flat, size, symbols), m.score(*M.split(part.column(0)))
        assert all(np.array_equal(a[k], b[k]) for k in a) and a["n"].tolist() == [len(M.words(t)) + 1 for t in part.column(0).to_pylist()]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_sorted_counting_equals_counting_one_by_one(monkeypatch, held):
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "RUN", 16)
    rng = np.random.default_rng(6)
    code = M.Code(np.array([50, 20, 9, 4, 2], np.int64))
    contexts, symbols = [rng.integers(0, 4, 100).astype(np.uint32) for _ in range(2)], rng.integers(0, 5, 100)
    counts, want = np.zeros((2, 1 << 8, 2), np.int32), np.zeros((2, 1 << 8, 2), np.int32)
    M.tally(contexts, code, symbols, 8, counts)
    for at, node, bit in zip(*code.expand(symbols)):
        for k, c in enumerate(contexts):
            want[k, M._slot(c[at : at + 1], np.array([node]), 8)[0], bit] += 1
    assert np.array_equal(counts, want)
    M.tally([c[:0] for c in contexts], code, symbols[:0], 8, counts)
    M._add(np.zeros(0, np.uint32), counts[0].reshape(-1))
    assert np.array_equal(counts, want)


def test_words_are_counted_whole_when_they_leave_early(spark, monkeypatch):
    texts = [prose(random.Random(k), [f"w{i}" for i in range(60)], 5) for k in range(30)] + ODD
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for w in (w for t in texts for w in [*M.words(t), M.END]):
        want[w] = want.get(w, 0) + 1
    for name, size in (("CACHE", 40), ("COUNTED", 200)):
        monkeypatch.setattr(M, name, size)
        assert {bytes(r.word): r.n for r in M.count_words(docs.repartition(3)).collect()} == want
    assert M.count_words(docs.limit(0)).collect() == []
