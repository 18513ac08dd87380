"""Near copies of the pipeline stage against all pairs."""

import random

import pyarrow as pa

import corpus_pipeline
from chronotrack.llm import near_dedup as N
from tests.llm.conftest import frame


def _edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"edit{rng.randrange(10**6)}"
    return out


def _data():
    rng = random.Random(4)
    names = [f"w{k}" for k in range(4000)]
    data, i = [], 0
    for group in range(20):
        base = [rng.choice(names) for _ in range(rng.randrange(150, 300))]
        for n in (0, 1, 2, 3, 5, 9):
            data.append([i, " ".join(_edited(rng, base, n)), "en", "s1"])
            i += 1
    hot = [rng.choice(names) for _ in range(400)]
    data += [[i + k, " ".join(_edited(rng, hot, k % 4)), "en", "s2"] for k in range(60)]
    return data


def test_components_are_those_of_all_similar_pairs(spark, data=None):
    data = data or _data()
    sets = {r[0]: N.shingles(r[1].encode()) for r in data}
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and N.similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    got = {r[0]: r[1] for r in N.near_components(frame(spark, data)).collect()}
    assert got == {k: find(k) for k in sets}


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Many texts that share half their words: large buckets whose members are no copies; small limits, so blocks meet."""
    monkeypatch.setattr(N, "SMALL_BUCKET", 2)
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(12)
    names = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(names) for _ in range(160)]
    data = []
    for group in range(20):
        base = [*passage, *(rng.choice(names) for _ in range(60))]
        data += [[3 * group + k, " ".join(_edited(rng, base, 2 * k)), "en", "s1"] for k in range(3)]
    test_components_are_those_of_all_similar_pairs(spark, data)


def test_stage_drops_edited_copies(spark):
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, _data()), "").collect()}
    assert 0 in kept and 1 not in kept and 2 not in kept
    assert [k for k in kept if k >= 120] == [120]


def test_large_buckets_give_no_pairs():
    """Members of one bucket, most of them likely and few of them real copies: what leaves a kernel is bounded by their number."""
    rng = random.Random(3)
    names = [f"w{k}" for k in range(4000)]
    base = [rng.choice(names) for _ in range(150)]
    texts = [" ".join(_edited(rng, base, 5)) for _ in range(60)]
    texts[40:] = [" ".join(_edited(rng, t.split(), 1)) for t in texts[:20]]
    n, sets = len(texts), [N.shingles(t.encode()) for t in texts]
    rows = {"band": [0] * n, "key": [7] * n, "node": list(range(n)), "comp": list(range(n)), "sketch": [N.sketch(s)[1] for s in sets]}
    for blocks in (1, 2):
        rows |= {"own": [k // 40 * (blocks - 1) for k in range(n)], "i": [0] * n, "j": [blocks - 1] * n}
        close = N._between(pa.table(rows))
        assert n // 2 < close.num_rows <= n
        links = N._joined(close.append_column("text", pa.array([texts[k] for k in close.column("node").to_pylist()])))
        want = [(a, b) for a in range(n) for b in range(a) if N.similar(sets[a], sets[b]) and (blocks == 1 or a // 40 != b // 40)]
        assert 0 < len(want) < n and 0 < links.num_rows < n
        assert _labels(n, zip(*links.to_pydict().values())) == _labels(n, want)


def _labels(n, edges):
    top = list(range(n))
    for a, b in edges:
        x, y = sorted((top[a], top[b]))
        top = [x if t == y else t for t in top]
    return top


def test_long_texts_are_looked_up_in_runs(monkeypatch):
    monkeypatch.setattr(N, "TOGETHER", 300)
    test_large_buckets_give_no_pairs()
