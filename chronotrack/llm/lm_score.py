"""Language-model scores by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import forgettable, parts, release, trim
from chronotrack.llm._skew import attach
from chronotrack.llm._store import write_table
from chronotrack.llm.simhash import LOWER

#: The end of a text as a token; no word can hold a line end.
END = b"\n"
#: Words that get a code of their own, at most (a worker holds them); all others are spelled.
VOCABULARY = 1 << 18
#: Occurrences of a word of the vocabulary at least; the rarer ones teach the escape and the spelling.
MIN_COUNT = 2
#: Slots of each context order's table, as a power of two: of the word model, of the spelling model.
WORD_BITS, SPELL_BITS = 20, 18
WORD_ORDERS, SPELL_ORDERS = (1, 2), (1, 2, 3, 5)
#: Tokens of a block, after which the mixing weights are refined: BLOCK at first, from EARLY on a part of the tokens so far.
BLOCK, EARLY = 32, 512
RATE = 0.006
DELTA = 0.4
#: Rows of words and counts that a worker holds before it adds them up; sums over half of that leave it.
CACHE = 500_000
#: Bits of an input's level in the histogram of all training decisions that the starting weights are fitted on: the code's own, then each order.
WORD_LEVELS, SPELL_LEVELS = (5, 5, 5), (2, 3, 3, 4, 4)
#: Steps of a stretched prediction between 0 and 1; with the two bits of its confidence it takes 16 bits.
FINE = 1023
#: Bytes of the texts that are scored together, and counted or looked up in the vocabulary together.
TOGETHER, COUNTED = 1_000_000, 8_000_000
#: Symbols whose decisions are expanded at once; whole blocks are, so a block that is larger is one run.
RUN = 1 << 15
#: Decisions of an order that are sorted together before they are counted.
HELD = 1 << 20
#: Counts of a table that travel as one row.
SLOT_BLOCK = 2048
#: Steps of a count's binary logarithm by which the vocabulary is cut off.
STEPS = 8
#: A phrase ends after every PHRASE-th token (expected number; which tokens these are depends on the words alone).
PHRASE = 32
#: Context of a text's first phrase.
FIRST = 1
GATES = 16


def words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(LOWER).split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other (binary), and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, at = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty one
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full).cast(pa.binary()), np.diff(before[at])


def listed(ws: pa.Array) -> list[bytes]:
    """Words as a list, by way of their lines, which is much faster than one by one; no word holds a line end."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ws)], pa.int32()), ws), b"\n")[0].as_py().split(b"\n") if len(ws) else []


class Code:
    """A Huffman code: for each symbol the nodes on its path and the branches taken there; for each node the counts of both branches."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaf, inner = order.tolist(), []
        weight = [*counts.tolist(), *([0] * max(0, n - 1))]
        parent, side = [0] * len(weight), [0] * len(weight)
        i = j = 0
        for new in range(n, 2 * n - 1):
            for s in (0, 1):
                if j >= len(inner) or i < n and weight[leaf[i]] <= weight[inner[j]]:
                    pick, i = leaf[i], i + 1
                else:
                    pick, j = inner[j], j + 1
                parent[pick], side[pick] = new, s
                weight[new] += weight[pick]
            inner.append(new)
        parent, side, weight = np.array(parent), np.array(side, np.uint8), np.array(weight)
        at, nodes, bits, root = np.arange(n), [], [], 2 * n - 2
        while (live := at != root).any():
            nodes.append(np.where(live, parent[at] - n, -1).astype(np.int32))
            bits.append(side[at])
            at = np.where(live, parent[at], at)
        path = np.array(nodes[::-1], np.int32).reshape(-1, n).T
        used = path >= 0
        self.size = used.sum(axis=1).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.steps = (path[used] << 1) | np.array(bits[::-1], np.int32).reshape(-1, n).T[used]
        one = np.zeros(max(1, n - 1))
        np.add.at(one, parent[:-1][side[:-1] == 1] - n, weight[:-1][side[:-1] == 1])
        self.one, self.all = one, weight[n:] if n > 1 else np.zeros(1)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``symbols``, node and bit of each binary decision."""
        size = self.size.take(symbols)
        ends = np.cumsum(size)
        at = np.repeat(np.arange(len(symbols)), size)
        k = np.repeat(self.start.take(symbols) - (ends - size), size)
        k += np.arange(len(k))
        step = self.steps.take(k)
        return at, step >> 1, step.astype(np.uint8) & np.uint8(1)


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    x = node.astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x ^= context
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE3D)
    x >>= np.uint32(32 - bits)
    return x


def _add(places: np.ndarray, total: np.ndarray) -> None:
    """Count ``places`` (sorted here) into ``total``, whose size is far above a run's, so that a pass over it for every run is dear."""
    places.sort()
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(places)), bool), places[1:] != places[:-1])))
    total[places[starts]] += np.diff(starts, append=len(places)).astype(total.dtype)


def word_contexts(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of as many tokens before each token; keys: their hashes; first: whether the token begins a document."""
    before = np.concatenate(([0], (keys[:-1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))).astype(np.uint32)
    before[first] = 0
    two = np.concatenate(([0], before[:-1])).astype(np.uint32)
    two[first] = 0
    a = (before + np.uint32(1)) * np.uint32(0x27D4EB2F)
    return [a, (a ^ ((two + np.uint32(7)) * np.uint32(0x165667B1))) * np.uint32(0x9E3779B1)]


def phrases(keys: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last place of each phrase and hash of its tokens; last: whether the token ends a document.

    Whether a phrase ends after a token is decided by the hash of that token and the one before it, so equal passages
    fall into equal phrases wherever they stand.
    """
    two = (keys ^ (np.concatenate((np.zeros(1, np.uint64), keys[:-1])) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    ends = np.flatnonzero(((two >> np.uint64(33)) % np.uint64(PHRASE) == 0) | last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = (np.arange(len(keys)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64)
    x = (keys + place) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * (place * np.uint64(2) + np.uint64(0x94D049BB133111EB))
    return ends, np.add.reduceat(x ^ (x >> np.uint64(29)), starts).view(np.int64)


def spell_contexts(chars: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of as many characters before each one, as far as its word goes; place: position in the word."""
    out, h, back = [], np.zeros(len(chars), np.uint32), chars.astype(np.uint32)
    for n in range(1, max(SPELL_ORDERS) + 1):
        back = np.concatenate((np.zeros(1, np.uint32), back[:-1]))
        h = (h * np.uint32(0x2C1B3C6D)) ^ np.where(place >= n, back + np.uint32(1), np.uint32(0)) * np.uint32(0x297A2D39)
        if n in SPELL_ORDERS:
            out.append(h + np.uint32(n))
    return out


def tally(contexts: list[np.ndarray], code: Code, symbols: np.ndarray, bits: int, counts: np.ndarray) -> None:
    """Add the decisions of ``symbols`` to ``counts`` [orders, slots, 2]."""
    held, size = [[] for _ in contexts], 0
    for a in range(0, len(symbols), RUN):
        at, node, bit = code.expand(symbols[a : a + RUN])
        for c, places in zip(contexts, held):
            x = _slot(c[a : a + RUN].take(at), node, bits)
            x <<= np.uint32(1)
            x |= bit
            places.append(x)
        size += len(at)
        if size >= HELD or a + RUN >= len(symbols):
            for k, places in enumerate(held):
                _add(np.concatenate(places), counts[k].reshape(-1))
                places.clear()
            size = 0


def _confidence(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.uint8) + (n > 2) + (n > 15)


def _cost(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of decisions whose mixed stretch towards the right branch is z: natural log cost, and probability of the wrong branch."""
    small = np.abs(z)
    np.exp(np.negative(small, out=small), out=small)
    both = small + 1
    wrong = np.where(z >= 0, small, np.float32(1))
    wrong /= both
    cost = np.log(both, out=both)
    cost -= np.minimum(z, 0)
    return cost, wrong


def _stretch(packed: np.ndarray) -> np.ndarray:
    """Stretched prediction of packed values."""
    x = (packed & np.uint16(0x3FFF)).astype(np.float32)
    x -= np.float32(8192)
    x /= np.float32(FINE)
    return x


def _level(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x + 8) * ((1 << bits) / 16)).clip(0, (1 << bits) - 1).astype(np.uint8)


def _means(place: np.ndarray, x: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """Mean of x over the decisions that fall into each place."""
    n = np.bincount(place, times, 1 << bits)
    return np.bincount(place, x * times.astype(np.float64), 1 << bits) / np.maximum(n, 1)


class Binned(NamedTuple):
    """Cell of a decision: its bit, the level of the code's own prediction, then each order's level and, of the two longest, confidence.

    own: by node; tables: by slot and branch; shifts: place and number of each order's bits; means: the values of the levels.
    """

    own: np.ndarray
    tables: list[np.ndarray]
    shifts: list[tuple[int, int]]
    means: list[np.ndarray]
    cells: int


class Predictors:
    """Stretched predictions and confidences of a code's nodes and of the hashed contexts, with the weights that mix them.

    A gate, chosen by the confidences of the two longest contexts, selects the set of weights.
    """

    def __init__(self, code: Code, counts: np.ndarray, bits: int, weights: np.ndarray | None = None):
        self.code, self.bits, self.counts = code, bits, counts
        self.zero = np.log((code.one + 0.5) / (code.all - code.one + 0.5)).astype(np.float32)
        self.packed = [self.pack(n) for n in counts]
        self.weights = weights if weights is not None else self.plain()

    def plain(self) -> np.ndarray:
        w = np.zeros((GATES, 1 + len(self.counts)), np.float32)
        w[:, 0] = 1
        return w

    @staticmethod
    def pack(n: np.ndarray) -> np.ndarray:
        """Confidence (two bits) and stretched prediction (in steps of 1 / FINE, 14 bits) of each slot."""
        stretch = np.rint(np.log((n[:, 1] + DELTA) / (n[:, 0] + DELTA)).clip(-8, 8) * FINE) + 8192
        return stretch.astype(np.uint16) | (_confidence(n.sum(axis=1)).astype(np.uint16) << np.uint16(14))

    def inputs(self, contexts: list[np.ndarray], symbols: np.ndarray):
        """Position, bit, inputs [orders + 1, decisions] and gate of each decision."""
        at, node, bit = self.code.expand(symbols)
        x, sure = [self.zero.take(node)], []
        for k, c in enumerate(contexts):
            got = self.packed[k].take(_slot(c.take(at), node, self.bits))
            sure.append((got >> np.uint16(14)).astype(np.uint8))
            x.append(_stretch(got))
        return at, bit, x, sure[-1] * np.uint8(4) + sure[-2]

    def without_own(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Stretched prediction and confidence [slots, 2] that a decision of either branch meets in order k, itself left out of the counts."""
        stretch, sure = np.empty(self.counts[k].shape, np.float32), np.empty(self.counts[k].shape, np.uint8)
        for b in (0, 1):
            n = self.counts[k].astype(np.float32)
            n[:, b] = np.maximum(n[:, b] - 1, 0)
            stretch[:, b] = np.log((n[:, 1] + DELTA) / (n[:, 0] + DELTA)).clip(-8, 8)
            sure[:, b] = _confidence(n.sum(axis=1))
        return stretch, sure

    def binned(self, levels: tuple[int, ...]) -> Binned:
        """How decisions fall into a histogram of their inputs and gates; levels: bits of each input."""
        own = _level(self.zero, levels[0])
        at, tables, shifts, means = 1 + levels[0], [], [], [_means(own, self.zero, self.code.all, levels[0])]
        for k in range(len(self.counts)):
            stretch, sure = self.without_own(k)
            gated = k >= len(self.counts) - 2
            place = _level(stretch, levels[k + 1]) | (sure << np.uint8(levels[k + 1]) if gated else np.uint8(0))
            bits = levels[k + 1] + 2 * gated
            means.append(_means(place.ravel(), stretch.ravel(), self.counts[k].ravel(), bits))
            tables.append(place.ravel())
            shifts.append((at, bits))
            at += bits
        return Binned(own.astype(np.int32) << 1, tables, shifts, means, 1 << at)

    def histogram(self, binned: Binned, contexts: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """Number of decisions in each cell, each decision left out of its own counts."""
        total = np.zeros(binned.cells, np.int64)
        for a in range(0, len(symbols), 2 * RUN):
            at, node, bit = self.code.expand(symbols[a : a + 2 * RUN])
            cell = binned.own.take(node) | bit
            for c, table, (shift, _) in zip(contexts, binned.tables, binned.shifts):
                x = _slot(c[a : a + 2 * RUN].take(at), node, self.bits)
                x <<= np.uint32(1)
                x |= bit
                cell |= table.take(x).astype(np.int32) << shift
            _add(cell, total)
        return total

    def fit(self, binned: Binned, cells: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights of each gate by Newton's method on a histogram; a level's value is the mean of what fell into it."""
        bit, times = cells & 1, times.astype(np.float64)
        x, gate = [binned.means[0][(cells >> 1) & (len(binned.means[0]) - 1)]], np.zeros(len(cells), np.int64)
        for (shift, bits), mean in zip(binned.shifts, binned.means[1:]):
            x.append(mean[(cells >> shift) & ((1 << bits) - 1)])
        for (shift, bits), times_of in zip(binned.shifts[-2:], (1, 4)):
            gate += times_of * ((cells >> (shift + bits - 2)) & 3)
        k = len(x)
        start = np.full((GATES, k), 0.1)
        start[:, 0] = 1
        w, ridge = start.copy(), 50 * np.eye(k)
        for _ in range(12):
            p = 1 / (1 + np.exp(-sum(w[gate, a] * x[a] for a in range(k)).clip(-30, 30)))
            g = np.stack([np.bincount(gate, times * (bit - p) * x[a], GATES) for a in range(k)], axis=1) - 50 * (w - start)
            v = times * p * (1 - p)
            h = np.zeros((GATES, k, k))
            for a in range(k):
                for b in range(a + 1):
                    h[:, a, b] = h[:, b, a] = np.bincount(gate, v * x[a] * x[b], GATES)
            w = w + np.linalg.solve(h + ridge, g[:, :, None])[:, :, 0].clip(-1, 1)
        w[np.bincount(gate, times, GATES) == 0] = self.plain()[0]
        return w.astype(np.float32)

    def static(self, contexts: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol with the starting weights."""
        at, bit, x, gate = self.inputs(contexts, symbols)
        z = sum(self.weights[gate, k] * x[k] for k in range(len(x)))
        return -np.bincount(at, _cost(np.where(bit == 1, z, -z))[0], len(symbols))

    def online(self, contexts: list[np.ndarray], symbols: np.ndarray, lane: np.ndarray, place: np.ndarray, lanes: int) -> np.ndarray:
        """Natural log probability of each symbol. Each lane (text) has weights of its own, refined after each of its blocks; place: position in the lane."""
        if not len(symbols):
            return np.zeros(0)
        place = place.astype(np.int64)
        block = np.where(place < EARLY, place // BLOCK, EARLY // BLOCK + (np.log(np.maximum(place, EARLY) / EARLY) * (EARLY // BLOCK)).astype(np.int64))
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.diff(block[order], prepend=-1, append=block.max() + 1))
        w = [np.tile(self.weights[:, k], lanes) for k in range(1 + len(contexts))]
        out = np.empty(len(symbols))
        for blocks in np.split(starts[:-1], np.flatnonzero(np.diff(starts[:-1] // RUN)) + 1):
            run = order[blocks[0] : starts[np.searchsorted(starts, blocks[-1]) + 1]]
            at, bit, x, gate = self.inputs([c[run] for c in contexts], symbols[run])
            group = (lane[run].astype(np.int64) * GATES).take(at) + gate
            sign, costs = bit.astype(np.float32) * 2 - 1, np.zeros(len(at), np.float32)
            cuts = np.searchsorted(at, np.append(blocks - blocks[0], len(run))).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                g, s = group[a:b], sign[a:b]
                z = w[0].take(g) * x[0][a:b]
                for k in range(1, len(x)):
                    z += w[k].take(g) * x[k][a:b]
                costs[a:b], wrong = _cost(s * z)
                err = s * wrong * np.float32(RATE * EARLY / max(EARLY, int(place[run[at[a]]])))  # by the place where the block begins
                if 16 * (b - a) < len(w[0]):  # few lanes are left
                    used, g = np.unique(g, return_inverse=True)
                    for k in range(len(x)):
                        w[k][used] += np.bincount(g, err * x[k][a:b], len(used)).astype(np.float32)
                else:
                    for k in range(len(x)):
                        w[k] += np.bincount(g, err * x[k][a:b], len(w[k])).astype(np.float32)
            out[run] = -np.bincount(at, costs, len(run))
        return out


class Model:
    """Vocabulary, both predictor sets, and what base scores need."""

    def __init__(self, vocabulary: pa.Array, counts: np.ndarray, tokens: int, different: int, end: int, code: Code):
        """counts: of the vocabulary; two more symbols follow: a spelled word and the end."""
        self.vocabulary = vocabulary
        self.spelled = len(vocabulary)
        self.end = self.spelled + 1
        self.code = code
        self.denominator = math.log10(tokens + 0.5 * (different + 1))
        self.base = np.append(np.log10(counts + 0.5) - self.denominator, [0.0, math.log10(end + 0.5) - self.denominator])
        self.end_seen = end
        self.keys = np.array([xxhash.xxh64_intdigest(w) for w in [*listed(vocabulary), b"", END]], np.uint64)
        self.learned = ""
        self.word: Predictors | None = None
        self.spell: Predictors | None = None

    def find(self, flat: pa.Array) -> np.ndarray:
        """Symbols of words. Each call hashes the vocabulary anew, so it takes many words."""
        return pc.index_in(flat, value_set=self.vocabulary).fill_null(self.spelled).to_numpy()

    def tokens(self, flat: pa.Array, size: np.ndarray, found: np.ndarray | None = None) -> Tokens:
        """Of texts as ``split`` gives them; found: their words' symbols."""
        found = self.find(flat) if found is None else found
        n = size + 1
        ends = np.cumsum(n)
        inner = np.ones(int(n.sum()), bool)
        inner[ends - 1] = False
        ids = np.full(len(inner), self.end, np.int32)
        ids[inner] = found
        rare = np.flatnonzero(ids == self.spelled)
        other = listed(flat.filter(pa.array(found == self.spelled)))
        keys = self.keys.take(ids)
        keys[rare] = np.fromiter(map(xxhash.xxh64_intdigest, other), np.uint64, len(other))
        return Tokens(ids, keys, n, ends, rare, other)

    def score(self, flat: pa.Array, size: np.ndarray, found: np.ndarray | None = None) -> dict:
        """Of each text: tokens, known ones of the vocabulary, their base score, the model's score (both log10), the other words with their numbers, phrases and their scores."""
        t = self.tokens(flat, size, found)
        texts = len(size)
        doc = np.repeat(np.arange(texts), t.n)
        place = np.arange(len(t.ids)) - np.repeat(t.ends - t.n, t.n)
        logs = self.word.online(word_contexts(t.keys, place == 0), t.ids, doc, place, texts)
        if t.other:
            chars, inside, letters_of = spelled(t.other)
            stop = np.cumsum(letters_of)
            lane = np.repeat(doc[t.rare], letters_of)
            begin = np.searchsorted(lane, np.arange(texts))
            letters = self.spell.online(spell_contexts(chars, inside), chars, lane, np.arange(len(chars)) - begin[lane], texts)
            logs[t.rare] += np.add.reduceat(letters, stop - letters_of)
        logs /= math.log(10)
        cuts = np.searchsorted(t.rare, t.ends).tolist()
        last = np.zeros(len(t.ids), bool)
        last[t.ends - 1] = True
        ends, phrase = phrases(t.keys, last)
        return {
            "n": t.n,
            "known": t.n - np.diff([0, *cuts]) - (self.end_seen == 0),
            "base": np.bincount(doc, self.base[t.ids], texts),
            "score": np.bincount(doc, logs, texts),
            "rare": [Counter(t.other[i:j]) for i, j in zip([0, *cuts[:-1]], cuts)],
            "phrases": np.searchsorted(ends, t.ends),
            "phrase": phrase,
            "cost": np.add.reduceat(logs, np.concatenate(([0], ends[:-1] + 1))),
        }


class Tokens(NamedTuple):
    """All tokens of some texts one after the other: symbols and hashes, number and last place of each text's tokens, places of the spelled words and these."""

    ids: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    ends: np.ndarray
    rare: np.ndarray
    other: list[bytes]


def groups(batches, column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Parts of the batches and their texts as ``split`` gives them."""
    for b in batches:
        for part in parts(b, column, limit):
            yield part, *split(part.column(column))


def looked_up(m: Model, batches, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """As ``groups`` with TOGETHER, and the words' symbols, which are found for COUNTED bytes at once."""
    for large, flat, size in groups(batches, column, COUNTED):
        found, ends, row = m.find(flat), np.concatenate(([0], np.cumsum(size))), 0
        for part in parts(large, column, TOGETHER):
            a, b = int(ends[row]), int(ends[row + part.num_rows])
            yield part, flat.slice(a, b - a), size[row : row + part.num_rows], found[a:b]
            row += part.num_rows


def spelled(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters (bytes, 256 ends a word), their places in the word, lengths with the end."""
    n = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(n)
    chars = np.frombuffer(b"\n".join([*ws, b""]), np.uint8).astype(np.int32)
    chars[ends - 1] = 256
    return chars, np.arange(len(chars)) - np.repeat(ends - n, n), n


def spell_code() -> Code:
    """A fixed code of bytes: the better known a byte range, the shorter (small letters, other ASCII, the rest)."""
    weight = np.full(257, 20)
    weight[33:127], weight[97:123], weight[256] = 100, 2000, 5000
    weight[list(b"etaoinsrh")] = 6000
    return Code(weight)


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n of the tokens of ``docs`` (text), the end of a text among them as END."""

    def count(batches):
        release()
        seen, texts = [], 0
        for _, flat, size in groups(batches, 0, COUNTED):
            each = flat.value_counts()
            seen.append(pa.table([each.field("values"), each.field("counts")], names=["word", "n"]))
            texts += len(size)
            if sum(map(len, seen)) > CACHE:
                seen = [pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
                if len(seen[0]) > CACHE // 2:
                    yield from seen.pop().to_batches()
        yield from chain.from_iterable(t.to_batches() for t in seen)
        if texts:
            yield pa.record_batch([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])
        del seen
        trim()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(df: DataFrame, orders: int, bits: int) -> np.ndarray:
    """Counts [orders, slots, 2]; their size is set by the parameters, not by the data. A group has one row of each task."""

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in table.column("counts"))
        return pa.table([table.column("block").slice(0, 1), pa.array([np.minimum(total, 1 << 30).astype("<i4").tobytes()])], names=["block", "counts"])

    counts = np.zeros((orders << bits) * 2, np.int32)
    got = df.groupBy("block").applyInArrow(merge, SLOTS).toArrow()
    for block, x in zip(got.column("block").to_pylist(), got.column("counts")):
        counts[block * SLOT_BLOCK :][:SLOT_BLOCK] = np.frombuffer(x.as_py(), "<i4")
    return counts.reshape(orders, 1 << bits, 2)


def _emit(counts: np.ndarray):
    """Blocks of the table that are not empty."""
    flat = counts.reshape(-1, SLOT_BLOCK)
    used = np.flatnonzero(flat.any(axis=1))
    for k in range(0, len(used), 256):
        part = used[k : k + 256]
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array([flat[x].astype("<i4", copy=False).tobytes() for x in part.tolist()], pa.binary())], names=["block", "counts"])


_models: dict[str, Model] = {}
forgettable(_models.clear)


def _model(sent, tables=None, weights=None) -> Model:
    """The worker's own, kept between tasks. Vocabulary and tables come apart, so a worker holds either once."""
    key, build = sent.value
    if key not in _models:
        _models.clear()
        _models[key] = Model(*build)
    m = _models[key]
    if tables and m.learned != tables.value[0]:
        m.learned, (a, b) = tables.value
        m.word, m.spell = Predictors(m.code, a, WORD_BITS), Predictors(spell_code(), b, SPELL_BITS)
    if weights:
        m.word.weights, m.spell.weights = weights
    return m


def _key(*parts: bytes) -> str:
    h = hashlib.md5()
    for x in parts:
        h.update(hashlib.md5(x).digest())
    return h.hexdigest()


SLOTS = "block int, counts binary"
SCORED = "n_tokens long, known long, base double, score double, bytes long, rare array<struct<word:binary,times:long>>, phrase array<long>, cost array<float>"


def few(df: DataFrame) -> DataFrame:
    """``df`` in two partitions a core at most: a task that ends with a table of fixed size shuffles it once, however much it has read."""
    return df.coalesce(max(2, 2 * df.sparkSession.sparkContext.defaultParallelism))


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row; learned from the rows of ``train``.

    Tokens: lower-cased words between white space, then one end. The model codes each token by binary decisions: the path
    of a Huffman code over the vocabulary (the most frequent words, at most ``vocabulary``), an escape and the end; an
    escaped word is spelled byte by byte. Each decision's probability is a logistic mix of bit predictors: the node's own
    count and hashed contexts of one and two tokens (bytes: one, two, three and five), learned from all training
    rows. A gate picks the set of mixing weights; both sets are refined online after each block of a text and carried to
    its end, whatever its length. Above them stands one predictor whose table grows with the corpus: after each phrase
    (about PHRASE tokens) the phrase that followed it most often elsewhere is predicted as a whole, see ``_phrase_gains``.
    score is the log10 probability of the tokens.

    Null text counts as empty: one token, the end, and bits_per_byte null. A null id's row counts as training by ``train``
    (null: no). Nothing to learn from: counts are zero and the model is the fixed spelling code. Repeated rows get a row
    each. Other columns are ignored; empty input gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    learn = rows.where("train")
    counts = write_table(count_words(few(learn.select("text"))), "words")
    total = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    tokens, different, ends = (int(x or 0) for x in total)
    # The vocabulary: counts from a step of their logarithm on, the lowest that keeps it within its size.
    step = F.floor(F.log2("n") * STEPS).cast("int")
    word = counts.where(F.col("word") != END)
    least, room, lowest = 1 << 30, vocabulary, math.floor(math.log2(MIN_COUNT) * STEPS)
    for r in sorted(word.groupBy(step.alias("s")).count().collect(), key=lambda r: -r[0]):
        room -= r[1]
        if room < 0 or r[0] < lowest:
            break
        least = r[0]
    chosen = word.where(step >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    known = chosen.column("n").to_numpy().astype(np.int64)
    code = Code(np.concatenate((known, [max(1, tokens - int(known.sum()) - ends), max(1, ends)])))
    build = (pa.concat_arrays(chosen.column("word").chunks), known, tokens, different, ends, code)
    sent = spark.sparkContext.broadcast((_key(b"\n".join(listed(build[0])), known.tobytes(), repr(build[2:5]).encode()), build))
    rare = word.where(step < least)

    def word_counts(batches):
        m = _model(sent)
        own = np.zeros((len(WORD_ORDERS), 1 << WORD_BITS, 2), np.int32)
        for _, flat, size in groups(batches, 0, COUNTED):
            t = m.tokens(flat, size)
            tally(word_contexts(t.keys, _first(t)), m.code, t.ids, WORD_BITS, own)
        yield from _emit(own)
        del own
        trim()

    def spell_counts(batches):
        own = np.zeros((len(SPELL_ORDERS), 1 << SPELL_BITS, 2), np.int32)
        for ws in _word_lists(batches):
            chars, place, _ = spelled(ws)
            tally(spell_contexts(chars, place), spell_code(), chars, SPELL_BITS, own)
        yield from _emit(own)
        del own
        trim()

    a = _summed(few(learn.select("text")).mapInArrow(word_counts, SLOTS), len(WORD_ORDERS), WORD_BITS)
    b = _summed(few(rare.select("word")).mapInArrow(spell_counts, SLOTS), len(SPELL_ORDERS), SPELL_BITS)
    tables = spark.sparkContext.broadcast((_key(a.tobytes(), b.tobytes()), (a, b)))
    weights = _starting_weights(learn, rare, sent, tables)

    def score(batches):
        m = _model(sent, tables, weights)
        for part, flat, size, symbols in looked_up(m, batches, 2):
            x = m.score(flat, size, symbols)
            offsets = pa.array(np.concatenate(([0], np.cumsum(list(map(len, x["rare"]))))).astype(np.int32))
            word, times = (pa.array(list(chain.from_iterable(f(c) for c in x["rare"])), k) for f, k in ((Counter.keys, pa.binary()), (Counter.values, pa.int64())))
            rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([word, times], names=["word", "times"]))
            at = pa.array(np.concatenate(([0], x["phrases"])).astype(np.int32))
            length = pc.fill_null(pc.binary_length(part.column(2)), 0).cast(pa.int64())
            one = [pa.array(x["n"], pa.int64()), pa.array(x["known"], pa.int64()), pa.array(x["base"]), pa.array(x["score"]), length, rare]
            yield pa.record_batch([*part.columns[:2], *one, pa.ListArray.from_arrays(at, pa.array(x["phrase"])), pa.ListArray.from_arrays(at, pa.array(x["cost"].astype(np.float32)))], names=["doc_id", "train", "n_tokens", "known", "base", "score", "bytes", "rare", "phrase", "cost"])
        trim()

    scored = rows.select("doc_id", "train", "text").mapInArrow(score, f"doc_id {id_type}, train boolean, {SCORED}")
    scored = write_table(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    found = scored.drop("rare", "phrase", "cost").join(_rare_base(scored, rare, tokens, different), "row", "left").join(_phrase_gains(scored), "row", "left")
    final = F.col("score") + F.coalesce("gain", F.lit(0.0))
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        final.alias("score"),
        F.when(F.col("bytes") > 0, -final * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


def _first(t: Tokens) -> np.ndarray:
    first = np.zeros(len(t.ids), bool)
    first[t.ends - t.n] = True
    return first


def _word_lists(batches) -> Iterator[list[bytes]]:
    for b in batches:
        for part in parts(b, 0, TOGETHER // 4):
            yield listed(part.column(0))


def _rare_base(scored: DataFrame, counts: DataFrame, tokens: int, different: int) -> DataFrame:
    """row, more (known tokens), rest (base score) of the words outside the vocabulary, whose counts come by a shuffle.

    Each row has each word once. A word that training has not seen may still be in many rows, so they are joined by
    their number of rows.
    """
    uses = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    seen = uses.groupBy("word").agg(F.count(F.lit(1)).alias("uses")).join(counts, "word", "left")
    found = attach(uses, write_table(seen, "lm-rare"), ["word"], "uses", F.col("row"))
    own = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - math.log10(tokens + 0.5 * (different + 1))
    return found.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * own).alias("rest"))


def _phrase_gains(scored: DataFrame) -> DataFrame:
    """row, gain: what the phrase predictor adds to the log10 score.

    The context is the phrase before. Its table holds, for every phrase of all training rows, how often it occurred and
    which phrase followed it most often; a training row's own occurrence is taken out. The gate is the confidence of the
    context (how often, what share had the same follower); for each gate the probability p of a hit is the share of hits
    among all training phrases. A phrase's probability is then p + (1 - p) m when it is the predicted one and (1 - p) m
    when not, m being that of its tokens.
    """
    before = F.concat(F.array(F.lit(FIRST).cast("long")), F.slice("phrase", 1, F.greatest(F.size("phrase") - 1, F.lit(0))))
    each = scored.select("row", "train", F.explode(F.arrays_zip(before.alias("ctx"), "phrase", "cost")).alias("x")).select("row", "train", "x.ctx", "x.phrase", "x.cost")
    pairs = each.where("train").groupBy("ctx", "phrase").agg(F.count(F.lit(1)).alias("k"))
    table = pairs.groupBy("ctx").agg(F.sum("k").alias("n"), F.max(F.struct("k", "phrase")).alias("best"))
    table = write_table(table.select("ctx", "n", F.col("best.phrase").alias("guess"), F.col("best.k").alias("k")), "lm-phrases")
    met = attach(each, table, ["ctx"], "n", F.col("row"))
    hit = F.col("phrase") == F.col("guess")
    own = F.col("train").cast("long")
    met = met.select("row", "train", "cost", hit.alias("hit"), (F.col("n") - own).alias("n"), (F.col("k") - F.when(hit, own).otherwise(0)).alias("k")).where("n > 0 and k > 0")
    gate = F.least(F.floor(F.log2("n")), F.lit(5)) * 5 + F.floor(F.col("k") / F.col("n") * 4)
    met = write_table(met.select("row", "train", "cost", "hit", gate.cast("int").alias("gate")), "lm-hits")
    seen = {r[0]: (r[1] + 0.5) / (r[2] + 1) for r in met.where("train").groupBy("gate").agg(F.sum(F.col("hit").cast("long")), F.count(F.lit(1))).collect()}
    p = F.coalesce(*[F.when(F.col("gate") == g, F.lit(x)) for g, x in sorted(seen.items())], F.lit(0.5))
    words = F.pow(F.lit(10.0), F.greatest(F.col("cost").cast("double"), F.lit(-300.0)))
    gain = F.when(F.col("hit"), F.log10(p + (1 - p) * words) - F.col("cost")).otherwise(F.log10(1 - p))
    return met.groupBy("row").agg(F.sum(gain).alias("gain"))


def _starting_weights(learn: DataFrame, rare: DataFrame, sent, tables) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights of the word and the spelling predictors, from the decisions of all training rows and of all rare words.

    Tasks count how often each combination of levels of the inputs, gate and branch occurs; the numbers are whole, so their sums
    don't depend on the partitions. The fit is on these sums.
    """

    def cells(total):
        used = np.flatnonzero(total)
        return pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["cell", "n"])

    def of_words(batches):
        m = _model(sent, tables)
        how = m.word.binned(WORD_LEVELS)
        total = np.zeros(how.cells, np.int64)
        for _, flat, size in groups(batches, 0, COUNTED):
            t = m.tokens(flat, size)
            total += m.word.histogram(how, word_contexts(t.keys, _first(t)), t.ids)
        yield cells(total)
        del how, total
        trim()

    def of_spelling(batches):
        m = _model(sent, tables)
        how = m.spell.binned(SPELL_LEVELS)
        total = np.zeros(how.cells, np.int64)
        for ws in _word_lists(batches):
            chars, place, _ = spelled(ws)
            total += m.spell.histogram(how, spell_contexts(chars, place), chars)
        yield cells(total)
        del how, total
        trim()

    def fitted(df: DataFrame, kernel, own: Predictors, levels: tuple[int, ...]) -> np.ndarray:
        got = few(df).mapInArrow(kernel, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
        return own.fit(own.binned(levels), got.column("cell").to_numpy(), got.column("n").to_numpy())

    a, b = tables.value[1]
    words_of = fitted(learn.select("text"), of_words, Predictors(sent.value[1][-1], a, WORD_BITS), WORD_LEVELS)
    return words_of, fitted(rare.select("word"), of_spelling, Predictors(spell_code(), b, SPELL_BITS), SPELL_LEVELS)
