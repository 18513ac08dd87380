"""Language identification by piece unigrams summed over all segmentations."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import forgettable, parts, release
from chronotrack.llm._pieces import DEFAULT_MODEL, Pieces, code_points, full, units

#: Documents that the fit takes of each language (expected number: a row is taken where a hash of its id is small enough).
FIT_DOCS = 400
#: Languages that are scored at once; with more, the kept units and the texts taken together get fewer in proportion.
LANGUAGE_BLOCK = 64
EM_ROUNDS = 3
SMOOTHING = 0.05
#: Probability of one character outside the vocabulary.
UNKNOWN = 1e-7
SHORT = 40
CACHE = 300_000
TOGETHER = 2_000_000
UNDECIDED = "und"


@functools.lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces.load(model)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def _blocks(us: list[str]):
    us = sorted(us, key=len)
    for k in range(0, len(us), 4096):
        yield us[k : k + 4096]


def forward(p: Pieces, prob: np.ndarray, block: list[str]) -> np.ndarray:
    """Log probability of each unit in each language: the sum over all segmentations. prob: [pieces + 1, languages], last row 0."""
    whole = list(map(full, block))
    n = np.fromiter(map(len, whole), np.int64, len(whole))
    if n.max() > SHORT:
        return np.stack([_long(p, prob, u) for u in whole])
    alpha = np.zeros((int(n.max()) + 1, len(whole), prob.shape[1]))
    alpha[0] = 1
    for end, options in p.edges(code_points(whole, int(n.max()))):
        for size, k in options:
            if size > 1:
                alpha[end] += alpha[end - size] * prob[k]
            else:
                alpha[end] += alpha[end - 1] * np.where((k < 0)[:, None], UNKNOWN, prob[k])
    return np.log(alpha[n, np.arange(len(n))])


def _long(p: Pieces, prob: np.ndarray, u: str) -> np.ndarray:
    """The same for one unit of any length, rescaled at each character."""
    window = [np.zeros(prob.shape[1])] * (p.longest - 1) + [np.ones(prob.shape[1])]
    scale = np.zeros(prob.shape[1])
    for end in range(1, len(u) + 1):
        x = np.zeros(prob.shape[1])
        for size in range(1, min(end, p.longest) + 1):
            k = p.index.get(u[end - size : end], -1)
            if k >= 0:
                x = x + window[-size] * prob[k]
            elif size == 1:
                x = x + window[-1] * UNKNOWN
        window = [*window[1:], x]
        top = x.copy()
        top[top <= 0] = 1
        scale += np.log(top)
        window = [w / top for w in window]
    return scale + np.log(np.maximum(window[-1], 1e-300))


def fit(samples: list[tuple[str, str]], model: str = DEFAULT_MODEL, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities [pieces + 1, languages] from (language, text): expectation-maximisation over all segmentations."""
    return _fit_sorted(sorted(samples, key=lambda s: s[0]), model, rounds)


def _fit_sorted(samples, model: str, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """The same from samples in the order of their languages, of which one language's units are held at a time."""
    p, langs, columns = pieces(model), [], []
    for lang, group in itertools.groupby(samples, key=lambda s: s[0]):
        counts: Counter = Counter()
        for _, text in group:
            counts.update(units(text.lower()))
        langs.append(lang)
        columns.append(_fit_one(p, counts, rounds))
    return langs, np.stack(columns, axis=1) if columns else np.zeros((len(p.strings) + 1, 0))


def _fit_one(p: Pieces, counts: Counter, rounds: int) -> np.ndarray:
    short, long = [u for u in counts if len(u) < SHORT], [u for u in counts if len(u) >= SHORT]
    start = 1.0 / (np.arange(len(p.strings)) + 100.0)
    now = np.append(start / start.sum(), 0)
    for _ in range(rounds):
        seen = np.zeros(len(p.strings) + 1)
        for block in _blocks(short):
            seen += _expected(p, now, block, np.array([counts[u] for u in block], float))
        values = now.tolist()
        for u in long:
            _expected_long(p, values, u, counts[u], seen)
        now = seen[:-1] + SMOOTHING
        now = np.append(now / now.sum(), 0)
    return now


def _expected_long(p: Pieces, prob: list[float], unit: str, weight: float, seen: np.ndarray) -> None:
    """Add the expected uses of each piece in one unit of any length.

    Forward with logarithms; then backward the probability that a piece ends at each place, dealt to the pieces that end there.
    """
    u, get = full(unit), p.index.get
    log, edges = [0.0], []
    for end in range(1, len(u) + 1):
        found = []
        for start in range(max(0, end - p.longest), end):
            k = get(u[start:end], -1)
            if k >= 0 or start == end - 1:
                found.append((start, k, (prob[k] if k >= 0 else UNKNOWN) * math.exp(log[start] - log[-1])))
        total = sum(f[2] for f in found)
        edges.append([(start, k, x / total) for start, k, x in found])
        log.append(log[-1] + math.log(total))
    ends = [0.0] * len(u) + [1.0]
    for end in range(len(u), 0, -1):
        for start, k, x in edges[end - 1]:
            ends[start] += (share := ends[end] * x)
            seen[k] += weight * share


def _expected(p: Pieces, prob: np.ndarray, block: list[str], weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, by the forward-backward algorithm."""
    whole = list(map(full, block))
    n = np.fromiter(map(len, whole), np.int64, len(whole))
    width, rows = int(n.max()), np.arange(len(whole))
    edges = [(end, [(size, k, np.where(k < 0, UNKNOWN, prob[k]) if size == 1 else prob[k]) for size, k in options]) for end, options in p.edges(code_points(whole, width))]
    alpha = np.zeros((width + 1, len(whole)))
    alpha[0] = 1
    for end, options in edges:
        for size, _, x in options:
            alpha[end] += alpha[end - size] * x
    beta = np.zeros((width + 1, len(whole)))
    beta[n, rows] = 1
    scale = weight / alpha[n, rows]
    seen = np.zeros(len(prob))
    for end, options in reversed(edges):
        for size, k, x in options:
            beta[end - size] += beta[end] * x
            seen += np.bincount(np.where(k < 0, len(prob) - 1, k), alpha[end - size] * x * beta[end] * scale, len(prob))
    return seen


class Scorer:
    def __init__(self, langs: list[str], prob: np.ndarray, model: str):
        self.p, self.langs, self.prob = pieces(model), langs, prob
        self.row: dict[str, int] = {}
        part = LANGUAGE_BLOCK / max(LANGUAGE_BLOCK, len(langs))
        self.together = int(TOGETHER * part)
        self.logs = np.zeros((int(CACHE * part), len(langs)))

    def ready(self, wanted: set[str]) -> None:
        new = wanted.difference(self.row)
        if len(self.row) + len(new) > len(self.logs):
            self.row.clear()
            new = wanted
            if len(new) > len(self.logs):
                self.logs = np.zeros((len(new), len(self.langs)))
        for block in _blocks(list(new)):
            at = len(self.row)
            for k in range(0, len(self.langs), LANGUAGE_BLOCK):
                self.logs[at : at + len(block), k : k + LANGUAGE_BLOCK] = forward(self.p, self.prob[:, k : k + LANGUAGE_BLOCK], block)
            self.row.update(zip(block, range(at, at + len(block))))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores, at = [], [], 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and chars < self.together:
                t = texts[at]
                group.append(units(t.lower()) if t and any(map(str.isalpha, t)) else None)
                chars += len(t or "")
                at += 1
            if self.langs:
                self.ready({u for g in group if g for u in g})
            for g in group:
                if g is None or not self.langs:
                    names.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                x = self.logs[list(map(self.row.__getitem__, g))].sum(axis=0)
                best = int(x.argmax())
                names.append(self.langs[best])
                scores.append(float(1 / np.exp(x - x[best]).sum()))
        return names, scores


_scorers: dict[bytes, Scorer] = {}
forgettable(_scorers.clear)


def _scorer(langs: list[str], prob: np.ndarray, model: str) -> Scorer:
    """The worker's own, kept between tasks; known by all bytes of the model."""
    key = hashlib.md5(repr((model, list(langs), prob.shape)).encode() + np.ascontiguousarray(prob).tobytes()).digest()
    if key not in _scorers:
        release()
        _scorers[key] = Scorer(langs, prob, model)
    return _scorers[key]


def learn_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_docs: int = FIT_DOCS, model: str = DEFAULT_MODEL):
    """Fit on a hash sample of the labelled rows: about ``fit_docs`` of each language, whole texts."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").count()
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(sizes), "lang").where(u < F.lit(float(fit_docs)) / F.col("count")).select("lang", "text")
    return _fit_sorted(((r[0], r[1]) for r in some.orderBy("lang").toLocalIterator()), model)


def identify_languages(
    docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, model: str = DEFAULT_MODEL
) -> DataFrame:
    """id, lang_pred, score for each row of ``docs``; learned from ``train`` (id, text, lang; by default ``docs``).

    A text, lower-cased, is cut into units at spaces and line ends, which no piece crosses. A unit's probability in a
    language is the sum over all its segmentations into pieces (forward algorithm); a text's is the product over its
    units. score is the share of the best language, all languages equally likely beforehand.

    `und` with score 0: null text, no letter, or nothing to learn from. Ties: the first language by name. Rows with a
    null language teach nothing. Repeated rows get a row each. Other columns are ignored; empty input gives no rows.
    """
    langs, prob = learn_languages(docs if train is None else train, id_col, text_col, lang_col, fit_docs, model)
    sent = docs.sparkSession.sparkContext.broadcast((langs, prob))

    def predict(batches):
        scorer = _scorer(*sent.value, model)
        for b in chain.from_iterable(parts(whole, 1) for whole in batches):
            names, scores = scorer.score(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
