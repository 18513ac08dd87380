"""All languages, and texts without spaces, are learned."""

import random
from collections import Counter

import numpy as np

from chronotrack.llm import language_id as L
from tests.llm.conftest import frame


def test_more_languages_than_a_block(spark):
    rng, letters = random.Random(2), "abcdefghijklmnopqrstuvwxyz"
    data, i = [], 0
    for k in range(80):
        own = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)]
        for _ in range(3):
            data.append([i, " ".join(rng.choice(own) for _ in range(40)), f"l{k:02}", "s"])
            i += 1
    got = {r.doc_id: r.lang_pred for r in L.identify_languages(frame(spark, data)).collect()}
    assert got == {r[0]: r[2] for r in data}


def test_units_without_spaces_are_learned():
    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(300))
    a, b = "的一是不了人我在有他", "のにはをたがでてとし"
    langs, prob = L.fit([("ja", text(b)) for _ in range(20)] + [("zh", text(a)) for _ in range(20)])
    names, shares = L.Scorer(langs, prob, L.DEFAULT_MODEL).score([text(a), text(b), a * 2, b * 2])
    assert names == ["zh", "ja", "zh", "ja"] and min(shares) > 0.99


def test_expected_uses_of_long_units():
    p = L.pieces(L.DEFAULT_MODEL)
    start = 1.0 / (np.arange(len(p.strings)) + 100.0)
    prob = np.append(start / start.sum(), 0)
    us = ["internationalisation", "thequickbrownfox", "漢字𓀀x"]
    seen = np.zeros(len(prob))
    for u, n in Counter(us).items():
        L._expected_long(p, prob.tolist(), u, n, seen)
    assert np.allclose(seen, L._expected(p, prob, us, np.ones(len(us))), rtol=1e-9)


def test_a_worker_tells_models_apart():
    """Two models with equal languages and equal sums are two scorers; the same model is one."""
    p = np.full((len(L.pieces(L.DEFAULT_MODEL).strings) + 1, 2), 0.5)
    q = p.copy()
    q[0], q[1] = (0.6, 0.4), (0.4, 0.6)
    one = L._scorer(["a", "b"], p, L.DEFAULT_MODEL)
    assert L._scorer(["a", "b"], p.copy(), L.DEFAULT_MODEL) is one
    assert L._scorer(["a", "b"], q, L.DEFAULT_MODEL) is not one
