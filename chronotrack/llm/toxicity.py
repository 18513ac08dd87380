"""Toxicity by compression distance: windows under a dictionary trained on toxic and one trained on ordinary text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import parts

#: Labelled documents that the fit takes of each class (expected numbers, by a hash of the id).
FIT_TOXIC, FIT_ORDINARY = 1200, 2800
WINDOW, STEP = 96, 72
#: Bytes of the ordinary dictionary, and of the toxic one: the size with the best calibration is taken.
ORDINARY_BYTES, TOXIC_BYTES = 16384, (512, 1024, 2048)
#: Shortest match of the compressors, and length of the strings by which the dictionary trainer counts.
MATCH = 6
#: Gain in bytes from which a window is taken as toxic in training.
GAIN = 2
THRESHOLD = 0.3
FEATURES = 6


def windows(text: bytes) -> list[bytes]:
    t = text.lower()
    return [t[k : k + WINDOW] for k in range(0, max(1, len(t) - (WINDOW - STEP)), STEP)]


def grams(text: bytes) -> np.ndarray:
    """The strings of MATCH bytes in ``text`` as numbers, one for each place."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - MATCH + 1
    return sum(a[i : n + i] << np.uint64(8 * i) for i in range(MATCH)) if n > 0 else np.zeros(0, np.uint64)


def known_grams(texts: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(grams(t.lower())) for t in texts)]))


def strange(text: bytes, known: np.ndarray) -> list[bytes]:
    """The stretches of ``text`` in which no match of MATCH bytes can come from the text that gave ``known``."""
    g = grams(text)
    if not len(g):
        return []
    new = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] != g if len(known) else np.ones(len(g), bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], new.astype(np.int8), [0]))))
    return [text[a : b + MATCH - 1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def train(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A dictionary trained by zstandard; of too little text to train on, the text itself."""
    samples = [s for s in samples if len(s) >= 8]
    random.Random(7).shuffle(samples)
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)


def train_ordinary(texts: list[bytes]) -> bytes:
    return train([w for t in texts for w in windows(t)], ORDINARY_BYTES, 64, 8)


def stranger(texts: list[bytes], known: np.ndarray) -> list[list[tuple[bytes, list[bytes]]]]:
    """Of each text the windows with strange stretches, and these."""
    return [[(w, found) for w in windows(t) if (found := strange(w, known))] for t in texts]


def train_toxic(toxic: list[list[tuple[bytes, list[bytes]]]], ordinary: bytes, size: int) -> bytes:
    """The toxic dictionary, from the ``stranger`` windows of toxic texts.

    Most of a toxic document reads like any other, and a dictionary of all of it would be one more ordinary dictionary. So
    it is trained on what ordinary text can't supply. Then the windows of each half of the documents that compress
    better under a dictionary of the other half are its training windows: what one document alone has goes.
    """
    shared = []
    for h in (0, 1):
        d = Distance(ordinary, train([s for t in toxic[h::2] for _, found in t for s in found], size, 8, MATCH))
        for t in toxic[1 - h :: 2]:
            shared += [s for w, found in t if d.gain(w) >= GAIN for s in found]
    return train(shared or [s for t in toxic for _, found in t for s in found], size, 8, MATCH)


class Distance:
    """Compressed lengths under both dictionaries.

    Both compressors hold the ordinary dictionary; the toxic one ends in the toxic dictionary, the ordinary one in as many
    bytes that occur in no text, so a window's two lengths differ only where toxic text helps.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        rng = random.Random(len(toxic))
        filler = bytes(rng.randrange(0xF8, 0x100) for _ in toxic)
        self.both = [self._compressor(ordinary + x).compress for x in (filler, toxic)]
        self.weights = weights

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        p = zstd.ZstdCompressionParameters(
            window_log=17, chain_log=14, hash_log=15, search_log=5, min_match=MATCH, target_length=32, strategy=zstd.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d = zstd.ZstdCompressionDict(content if len(content) >= 8 else b"\xff" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstd.ZstdCompressor(compression_params=p, dict_data=d)

    def gain(self, window: bytes) -> int:
        """Bytes that the window is shorter under the toxic dictionary."""
        plain, toxic = self.both
        return len(plain(window)) - len(toxic(window))

    def features(self, text: bytes) -> list[float]:
        gain = np.array([self.gain(w) for w in windows(text)])
        top = [*np.sort(gain)[: -4 : -1].clip(-2, 8).tolist(), 0, 0][:3]
        return [1.0, *top, min(2.0, float(gain.mean())), min(0.5, float((gain >= GAIN).mean()))]

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.weights, self.features(text)))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * len(y) ** 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * len(y) ** 0.5 * w)
    return w


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w
    return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))


def fit(samples: list[tuple[bytes, int]]) -> tuple[bytes, bytes, np.ndarray]:
    """Both dictionaries and the calibration, from (text, label); copies of a text count once.

    Each half of the documents is measured under dictionaries of the other half; these measurements calibrate the score
    and choose the size of the toxic dictionary. The final dictionaries are trained on both halves.
    """
    unique = sorted({(hashlib.sha256(t).digest(), t, y) for t, y in samples if t})
    split = [[[t for h, t, y in unique if y == k and h[0] % 2 == part] for k in (1, 0)] for part in (0, 1)]
    toxic, ordinary = ([t for part in split for t in part[k]] for k in (0, 1))
    if not all(toxic_half and ordinary_half for toxic_half, ordinary_half in split):
        share = (sum(y for _, _, y in unique) + 0.5) / (len(unique) + 1)
        return train_ordinary(ordinary), b"", np.array([np.log(share / (1 - share)), *[0.0] * (FEATURES - 1)])
    base = [(stranger(t, known_grams(o)), train_ordinary(o)) for t, o in split]
    y = np.array([k for t, o in split for k in [1] * len(t) + [0] * len(o)], float)
    best = None
    for size in TOXIC_BYTES:
        rows = []
        for other, (t, o) in zip((1, 0), split):
            d = Distance(base[other][1], train_toxic(*base[other], size))
            rows += [d.features(x) for x in [*t, *o]]
        x = np.array(rows)
        w = logistic(x, y)
        if best is None or loss(x, y, w) < best[0]:
            best = loss(x, y, w), size, w
    plain = train_ordinary(ordinary)
    return plain, train_toxic(stranger(toxic, known_grams(ordinary)), plain, best[1]), best[2]


_distances: dict[bytes, Distance] = {}


def _distance(ordinary: bytes, toxic: bytes, weights: np.ndarray) -> Distance:
    """The worker's own, kept between tasks."""
    key = hashlib.md5(b"".join(hashlib.md5(x).digest() for x in (ordinary, toxic, weights.tobytes()))).digest()
    if key not in _distances:
        _distances.clear()
        _distances[key] = Distance(ordinary, toxic, weights)
    return _distances[key]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY) -> DataFrame:
    """id, score (probability of label 1), predicted (score >= THRESHOLD) of each row of ``docs``, learned from ``labels``.

    Every window of each whole text is compressed with a dictionary of ordinary and one of toxic text; the differences
    (largest three, mean, share of windows) give the score by logistic calibration. Dictionaries and calibration come
    from a bounded hash sample of the labelled rows, of which whole texts are used. Null and empty texts have one empty
    window and get the score of no difference. An id with several labels counts as 1 if any is. No labels: score 0.5 for
    all. Ids or labels of null teach nothing. Repeated rows get a row each; other columns are ignored; empty input gives
    no rows.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    sizes = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    u = F.pmod(F.xxhash64(F.lit("toxic"), F.col("__id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__y") == 1, min(1.0, fit_toxic / max(1, sizes.get(1, 0)))).otherwise(min(1.0, fit_ordinary / max(1, sizes.get(0, 0))))
    taken = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known.where(u < share)), "__id")
    model = fit([(r[0].encode(), int(r[1])) for r in taken.where("text is not null").select("text", "__y").toLocalIterator()])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        score = _distance(*sent.value).score
        for b in batches:
            for part in parts(b, 1):
                s = [score(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(predict, f"doc_id {id_type}, score double")
    return out.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
