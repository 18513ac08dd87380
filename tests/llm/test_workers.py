"""Workers hold little between and inside the kernels of the pipeline."""

import pyarrow as pa

from chronotrack.llm import _batches as B
from chronotrack.llm import language_id as L
from chronotrack.llm import lm_score as M
from chronotrack.llm import near_dedup as N
from chronotrack.llm import sentencepiece_scan as S
from chronotrack.llm import simhash as H

TEXTS = ["one two three four five six", None, "", "a b", "one two three four five six"]


def test_kernels_of_another_operator_forget_the_models():
    L._scorers[b"x"] = None
    S.encoder(S.DEFAULT_MODEL)
    assert not L._scorers and S.encoder.cache_info().currsize == 1
    L._scorers[b"x"] = None
    list(N._digests(iter([pa.record_batch([[1], ["a"]], names=["node", "text"])])))
    assert not L._scorers and S.encoder.cache_info().currsize == 0


def test_release_forgets_the_language_model():
    M._models["x"] = None
    B.release()
    assert not M._models


def test_small_parts_give_the_same_rows(monkeypatch):
    ids = pa.array(range(len(TEXTS)), pa.int64())
    plain = lambda: [
        pa.Table.from_batches(H._fingerprints(iter([pa.record_batch([ids, pa.array(TEXTS)], names=["doc_id", "text"])]))).to_pylist(),
        pa.Table.from_batches(N._sketched(iter([pa.record_batch([ids, ids, pa.array(TEXTS)], names=["node", "comp", "text"])]))).to_pylist(),
    ]
    whole = plain()
    monkeypatch.setattr(B.parts, "__defaults__", (3,))
    assert plain() == whole and [r["node"] for r in whole[1]] == [0, 3, 4]


def test_verification_holds_texts_of_bounded_bytes(monkeypatch):
    monkeypatch.setattr(N, "PART", 20)
    pairs = [(TEXTS[0], TEXTS[4]), ("a b c d e f g", "a b c d e x y"), (TEXTS[0], TEXTS[0])] * 3
    batch = pa.record_batch([pa.array([0] * 9), pa.array([0] * 9), pa.array(range(9)), pa.array(range(10, 19)), pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])], names=["a", "b", "comp_a", "comp_b", "value_a", "value_b"])
    assert pa.Table.from_batches(N._verified(iter([batch]))).column("a").to_pylist() == [k for k in range(9) if k % 3 != 1]
