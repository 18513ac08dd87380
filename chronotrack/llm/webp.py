"""Lossless WebP: a writer and a complete reader, and documents stored as 8-bit sample images."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES, CACHE_MULTIPLIER = 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
SIGNATURE, MAX_SIDE, MAX_COPY, MAX_CODE = 0x2F, 16384, 4096, 15

#: Samples of a row of a document's image; rows are added up to the largest side, then further images follow.
WIDTH = 64
LEAST_COPY = 16


def near_distances() -> list[tuple[int, int]]:
    """(x, y) of the short distance codes 1 to 120: the places up to 7 rows above, nearest first."""
    at = [(x, y) for y in range(8) for x in range(-7 if y else 1, 9)]
    return sorted(at, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = near_distances()


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value of each length or distance code."""
    v = np.asarray(value, np.int64) - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    second = v >> np.maximum(high - 1, 0) & 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + second), extra, np.where(v < 4, 0, v & (1 << extra) - 1)


# --- prefix codes


def code_lengths(counts: list[int]) -> list[int]:
    """Huffman code lengths up to MAX_CODE; counts are flattened until they fit."""
    lengths = [0] * len(counts)
    used = [i for i, c in enumerate(counts) if c]
    if len(used) < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    weights = [counts[i] for i in used]
    while True:
        heap = list(zip(weights, range(len(used))))
        heapq.heapify(heap)
        n, parent = len(used), [0] * (2 * len(used) - 1)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            heapq.heapreplace(heap, (a + b, n))
            parent[i] = parent[j] = n
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= MAX_CODE:
            for i, d in zip(used, depth):
                lengths[i] = d
            return lengths
        weights = [w // 2 + 1 for w in weights]


_REVERSED = [np.array([int(f"{i:0{n}b}"[::-1], 2) if n else 0 for i in range(1 << n)], np.uint32) for n in range(0, 9)]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as they stand in the stream, first bit lowest."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.nonzero(lengths)[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    # Left-aligned, a code is the sum of what the codes before it take.
    left = (np.cumsum(1 << (MAX_CODE - n)) - (1 << (MAX_CODE - n))).astype(np.uint32)
    flipped = (_REVERSED[8][left & 255] << np.uint32(7)) | (_REVERSED[7][left >> 8])
    codes[order] = flipped
    return codes


class Prefix:
    """Reading table of a prefix code: for any ``bits`` bits, symbol << 4 | length. A code of one symbol takes no bits."""

    def __init__(self, lengths):
        if isinstance(lengths, int):
            self.only, self.bits, self.mask, self.table = lengths, 0, 0, None
            return
        used = np.nonzero(lengths)[0]
        self.only, self.bits = int(used[0]) if len(used) == 1 else -1, 0
        if self.only >= 0:
            self.table = np.array([self.only << 4], np.int32)
            self.mask = 0
            return
        n = lengths[used].astype(np.int64)
        self.bits = top = int(n.max()) if len(used) else 0
        if not top or int((1 << (top - n)).sum()) != 1 << top:
            raise ValueError("incomplete prefix code")
        self.mask = (1 << top) - 1
        order = np.argsort(n, kind="stable")
        n = n[order]
        aligned = np.repeat((used[order] << 4 | n).astype(np.int32), 1 << (top - n))
        self.table = aligned[_flip(top)]


_FLIP = ((_REVERSED[8][np.arange(1 << MAX_CODE) & 255] << np.uint32(7)) | _REVERSED[7][np.arange(1 << MAX_CODE) >> 8]).astype(np.int32)
_flips = {n: _FLIP[: 1 << n] >> (MAX_CODE - n) for n in range(1, MAX_CODE + 1)}
_flip = _flips.__getitem__


# --- bits


class BitWriter:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.some: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.some.append((value, n))

    def put_many(self, values: np.ndarray, n: np.ndarray) -> None:
        self.flush()
        self.parts.append((values.astype(np.uint32), n.astype(np.int64)))

    def flush(self) -> None:
        if self.some:
            v, n = zip(*self.some)
            self.parts.append((np.array(v, np.uint32), np.array(n, np.int64)))
            self.some = []

    def bytes(self) -> bytes:
        self.flush()
        v = np.concatenate([p[0] for p in self.parts])
        n = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum(n)
        shift = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - n, n)
        return np.packbits(((np.repeat(v, n) >> shift.astype(np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes()


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def get(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise ValueError("the stream is too short")
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)

    def symbol(self, code: Prefix) -> int:
        if code.only >= 0:
            return code.only
        a = self.at
        x = int(code.table[(int.from_bytes(self.data[a >> 3 : (a >> 3) + 3], "little") >> (a & 7)) & code.mask])
        self.at = a + (x & 15)
        if self.at > self.end:
            raise ValueError("the stream is too short")
        return x >> 4


# --- writing


def _write_code(out: BitWriter, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(0, 1)
    steps, i = [], 0
    while i < len(lengths):
        run = 1
        while i + run < len(lengths) and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            run = min(run, 138)
            steps.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            i += run
        else:
            steps.append((lengths[i], 0, 0))
            i += 1
    counts = [0] * 19
    for s, _, _ in steps:
        counts[s] += 1
    own = _limited(counts, 7)
    last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s])
    out.put(max(last + 1, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
        out.put(own[s], 3)
    out.put(0, 1)
    codes = canonical(np.array(own))
    single = sum(map(bool, own)) == 1
    for s, x, n in steps:
        if not single:
            out.put(int(codes[s]), own[s])
        if n:
            out.put(x, n)


def _limited(counts: list[int], most: int) -> list[int]:
    while max(lengths := code_lengths(counts)) > most:
        counts = [c and c // 2 + 1 for c in counts]
    return lengths


def line_copies(data: bytes) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that occurred before in ``data``, and of its last run of equal bytes."""
    found, seen, at = [], {}, 0
    for line in data.split(b"\n"):
        n = len(line)
        if n >= LEAST_COPY:
            before = seen.setdefault(line, at)
            if before < at and at - before < 1 << 20:
                found += [(at + k, min(MAX_COPY, n - k), at - before) for k in range(0, n, MAX_COPY)]
        at += n + 1
    tail = len(data) - len(data.rstrip(data[-1:])) if data else 0
    if tail > LEAST_COPY:
        start = len(data) - tail
        found = [c for c in found if c[0] + c[1] <= start]
        found += [(start + 1 + k, min(MAX_COPY, tail - 1 - k), 1) for k in range(0, tail - 1, MAX_COPY)]
    return found


def _write_pixels(out: BitWriter, argb: np.ndarray, width: int, copies=(), cache_bits: int = 0, main: bool = True, grey: bool = False) -> None:
    """Entropy-coded pixels (grey: only green varies, red and blue are 0, alpha 255); copies: (place, length, distance) in pixels, in order, without overlap."""
    n = len(argb)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    covered = np.zeros(n, bool)
    for at, size, _ in copies:
        covered[at : at + size] = True
    green = ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if grey:
        others, constant = [np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 255)], [True] * 3
    else:
        others = [((argb >> np.uint32(s)) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
        constant = [bool((x == x[0]).all()) for x in others]
    literal = ~covered
    cached = np.zeros(n, bool)
    if cache_bits:
        slots = _cache_slot(argb, cache_bits)
        held: dict[int, int] = {}
        for i, (s, p) in enumerate(zip(slots.tolist(), argb.tolist())):
            cached[i] = literal[i] and held.get(s, 0) == p
            held[s] = p
        green = np.where(cached, 256 + LENGTH_CODES + slots, green)
        literal &= ~cached
    heads = np.nonzero(literal | cached)[0]
    place = np.array([c[0] for c in copies], np.int64)
    size_symbol, size_bits, size_extra = prefix_of(np.array([c[1] for c in copies], np.int64))
    gap_symbol, gap_bits, gap_extra = prefix_of(np.array([c[2] + 120 for c in copies], np.int64))
    alphabet = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    first = np.concatenate((green[heads], 256 + size_symbol))
    counts = [np.bincount(first, minlength=alphabet).tolist()]
    counts += [[int(x[0])] if single else np.bincount(x[literal], minlength=256).tolist() for x, single in zip(others, constant)]
    counts.append(np.bincount(gap_symbol, minlength=DISTANCE_CODES).tolist())
    lengths, sizes, codes = [], [], []
    for k, c in enumerate(counts):
        if 1 <= k <= 3 and constant[k - 1]:
            out.put_many(np.array([1, 0, int(c[0] > 1), c[0]]), np.array([1, 1, 1, 8 if c[0] > 1 else 1]))
            lengths, sizes, codes = [*lengths, []], [*sizes, None], [*codes, None]
            continue
        own = code_lengths(c)
        _write_code(out, own)
        own = np.array(own)
        several = np.count_nonzero(own) > 1
        lengths.append(own)
        sizes.append(own if several else np.zeros(len(own), np.int64))
        codes.append(canonical(own) if several else np.zeros(len(own), np.uint32))
    # Columns of a token: green or length symbol, then red, blue, alpha of literals, or extra bits and distance of copies.
    value, bits = [codes[0][first]], [sizes[0][first]]
    if all(constant) and not len(place):
        out.put_many(value[0], bits[0])
        return
    order = np.argsort(np.concatenate((heads, place)), kind="stable")
    for k in range(3):
        if not constant[k] or len(place):
            if constant[k]:
                v = b = np.zeros(len(heads), np.int64)
            else:
                x = others[k][heads]
                v, b = codes[k + 1][x], np.where(literal[heads], sizes[k + 1][x], 0)
            cv, cb = ((size_extra, size_bits), (codes[4][gap_symbol], sizes[4][gap_symbol]), (gap_extra, gap_bits))[k]
            value.append(np.concatenate((v, cv)).astype(np.uint32))
            bits.append(np.concatenate((b, cb)))
    value, bits = np.stack(value, 1)[order].ravel(), np.stack(bits, 1)[order].ravel()
    use = bits > 0
    out.put_many(value[use], bits[use])


def _cache_slot(argb: np.ndarray, bits: int) -> np.ndarray:
    return ((argb.astype(np.uint32) * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - bits)).astype(np.int64)


def encode_argb(argb: np.ndarray, transforms: tuple = (), copies=(), cache_bits: int = 0) -> bytes:
    """A WebP file of ARGB pixels [height, width] (uint32).

    transforms, in order: (PREDICTOR, tile bits, modes [tiles]), (CROSS_COLOUR, tile bits, elements [tiles]),
    (SUBTRACT_GREEN,), (PALETTE,). ``copies`` count pixels of the image as it is after them.
    """
    height, width = argb.shape
    out = BitWriter()
    for v, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (int((argb >> 24 != 255).any()), 1), (0, 3)):
        out.put(v, n)
    x = argb.astype(np.uint32)
    for kind, *rest in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits, tiles = rest
            out.put(bits - 2, 3)
            tiles = np.asarray(tiles, np.uint32).reshape(-(-x.shape[0] >> bits) or 1, -1)
            _write_pixels(out, ((tiles << 8) if kind == PREDICTOR else tiles).ravel(), tiles.shape[1], main=False)
            x = _predict(x, bits, tiles, False) if kind == PREDICTOR else _cross(x, bits, tiles, False)
        elif kind == SUBTRACT_GREEN:
            g = x >> np.uint32(8) & np.uint32(255)
            x = x & np.uint32(0xFF00FF00) | ((x >> np.uint32(16)) - g & np.uint32(255)) << np.uint32(16) | (x - g) & np.uint32(255)
        else:
            colours, index = np.unique(x, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            out.put(len(colours) - 1, 8)
            _write_pixels(out, _minus(colours, np.concatenate((np.zeros(1, np.uint32), colours[:-1]))), len(colours), main=False)
            x = bundle(index.reshape(x.shape), len(colours))
    out.put(0, 1)
    _write_pixels(out, x.ravel(), x.shape[1], copies, cache_bits)
    body = out.bytes()
    body += b"\0" * (len(body) % 2)
    size = len(out.bytes())
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", size) + body


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def bundle(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indices as green values, several to a pixel if few colours need it."""
    b = bundle_bits(colours)
    if not b:
        return index.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    per, size = 1 << b, 8 >> b
    wide = np.zeros((index.shape[0], -(-index.shape[1] // per) * per), np.uint32)
    wide[:, : index.shape[1]] = index
    parts = wide.reshape(index.shape[0], -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(size))
    return parts.sum(axis=2, dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)


def _minus(a, b):
    return _channels(a, b, lambda x, y: x - y)


def _channels(a, b, f):
    a, b = np.asarray(a, np.uint32), np.asarray(b, np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for s in (0, 8, 16, 24):
        s = np.uint32(s)
        out |= (f(a >> s & np.uint32(255), b >> s & np.uint32(255)) & np.uint32(255)) << s
    return out


# --- reading


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels [height, width] (uint32) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return _decode_stream(BitReader(data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    raise ValueError("no lossless image")


def _decode_stream(r: BitReader) -> np.ndarray:
    if r.get(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height, _, version = r.get(14) + 1, r.get(14) + 1, r.get(1), r.get(3)
    if version:
        raise ValueError("unknown version")
    undo, w, seen = [], width, set()
    while r.get(1):
        kind = r.get(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.get(3) + 2
            tw, th = -(-w >> bits), -(-height >> bits)
            tw, th = (w + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            tiles = _read_pixels(r, tw, th, False).reshape(th, tw)
            undo.append((kind, bits, tiles, w))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, 0, None, w))
        else:
            n = r.get(8) + 1
            table = _read_pixels(r, n, 1, False)
            for s in (0, 8, 16, 24):
                part = np.cumsum(table >> np.uint32(s) & np.uint32(255), dtype=np.uint32) & np.uint32(255)
                table = table & np.uint32(0xFFFFFFFF ^ (255 << s)) | part << np.uint32(s)
            undo.append((kind, bundle_bits(n), table, w))
            w = (w + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
    x = _read_pixels(r, w, height, True).reshape(height, w)
    for kind, bits, tiles, w in reversed(undo):
        if kind == PREDICTOR:
            x = _predict(x, bits, tiles >> np.uint32(8) & np.uint32(255), True)
        elif kind == CROSS_COLOUR:
            x = _cross(x, bits, tiles, True)
        elif kind == SUBTRACT_GREEN:
            g = x >> np.uint32(8) & np.uint32(255)
            x = x & np.uint32(0xFF00FF00) | ((x >> np.uint32(16)) + g & np.uint32(255)) << np.uint32(16) | (x + g) & np.uint32(255)
        else:
            index = x >> np.uint32(8) & np.uint32(255)
            if bits:
                size = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(size)) & np.uint32((1 << size) - 1)).reshape(height, -1)[:, :w]
            full = np.zeros(256, np.uint32)
            full[: len(tiles)] = tiles
            x = full[index]
    return x


def _read_code(r: BitReader, alphabet: int) -> Prefix:
    if r.get(1):
        n = r.get(1) + 1
        first = r.get(8 if r.get(1) else 1)
        if n == 1:
            return Prefix(first)
        lengths = np.zeros(alphabet, np.int32)
        lengths[[first, r.get(8)]] = 1
        return Prefix(lengths)
    lengths = np.zeros(alphabet, np.int32)
    own = np.zeros(19, np.int32)
    for k in range(4 + r.get(4)):
        own[CODE_LENGTH_ORDER[k]] = r.get(3)
    code = Prefix(own)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
    i, before = 0, 8
    while i < alphabet and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
        else:
            run = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
            lengths[i : i + run] = before if s == 16 else 0
            i += run
    if i > alphabet:
        raise ValueError("too many code lengths")
    return Prefix(lengths)


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.get(4) if r.get(1) else 0
    groups, tile_bits, which = 1, 0, None
    if main and r.get(1):
        tile_bits = r.get(3) + 2
        tw, th = (width + (1 << tile_bits) - 1) >> tile_bits, (height + (1 << tile_bits) - 1) >> tile_bits
        which = (_read_pixels(r, tw, th, False) >> np.uint32(8) & np.uint32(0xFFFF)).reshape(th, tw)
        groups = int(which.max()) + 1
    alphabet = 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0)
    codes = [[_read_code(r, n) for n in (alphabet, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.only >= 0 for c in codes[0][1:4]):
        return _read_plain(r, width, width * height, codes[0])
    return _read_any(r, width, width * height, codes, tile_bits, which, cache_bits)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _extra(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + r.get(n) + 1


def _read_any(r, width, n, codes, tile_bits, which, cache_bits) -> np.ndarray:
    """Any stream, symbol by symbol."""
    out, i, cache, c = [0] * n, 0, [0] * (1 << cache_bits), codes[0]
    keep = lambda p: cache.__setitem__((p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits), p) if cache_bits else None
    while i < n:
        if which is not None:
            c = codes[int(which[(i // width) >> tile_bits, (i % width) >> tile_bits])]
        s = r.symbol(c[0])
        if s < 256:
            red, blue, alpha = r.symbol(c[1]), r.symbol(c[2]), r.symbol(c[3])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            keep(out[i])
            i += 1
        elif s < 256 + LENGTH_CODES:
            size = _extra(r, s - 256)
            d = _distance(_extra(r, r.symbol(c[4])), width)
            if d > i or i + size > n:
                raise ValueError("a copy runs out of the image")
            for _ in range(size):
                out[i] = out[i - d]
                keep(out[i])
                i += 1
        else:
            out[i] = cache[s - 256 - LENGTH_CODES]
            keep(out[i])
            i += 1
    return np.array(out, np.uint32)


def _read_plain(r: BitReader, width: int, n: int, codes: list[Prefix]) -> np.ndarray:
    """Streams in which only green varies: the symbol that would begin at every bit is looked up at once, then the chain is followed."""
    base = np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
    if codes[0].only >= 0 and codes[0].only < 256:
        return np.full(n, base | np.uint32(codes[0].only << 8), np.uint32)
    skip = r.at & 7
    data = np.frombuffer(r.data[r.at >> 3 :] + bytes(8), np.uint8)
    wide = data[:-3].astype(np.uint32)
    wide |= data[1:-2].astype(np.uint32) << np.uint32(8)
    wide |= data[2:-1].astype(np.uint32) << np.uint32(16)
    bits = (wide[:, None] >> np.arange(8, dtype=np.uint32)).ravel() & np.uint32(0x7FFF)
    found = codes[0].table[bits & np.uint32(codes[0].mask)]
    step = found & 15
    symbol = found >> 4
    last = len(bits) - 1
    after = np.minimum(np.arange(len(bits), dtype=np.int32) + step, last)
    copy = np.nonzero(symbol >= 256)[0]
    size = distance = None
    if len(copy):
        size, at = _extra_at(symbol[copy] - 256, after[copy], data, last)
        d = np.full(len(at), codes[4].only << 4) if codes[4].only >= 0 else codes[4].table[bits[at] & np.uint32(codes[4].mask)]
        distance, at = _extra_at(d >> 4, np.minimum(at + (d & 15), last), data, last)
        after[copy] = at
    # Follow the chain eight tokens at a time.
    two = after[after]
    four = two[two]
    eight = memoryview(four[four])
    p, starts = skip, []
    limit = last
    while p < limit and len(starts) * 8 < n:
        starts.append(p)
        p = eight[p]
    p = np.array(starts, np.int32)
    chain = np.empty((len(starts), 8), np.int32)
    for k in range(8):
        chain[:, k] = p
        p = after[p]
    chain = chain.ravel()
    s = symbol[chain]
    if len(copy):
        width_of = np.ones(len(bits), np.int64)
        width_of[copy] = size
        length = width_of[chain]
    else:
        length = np.ones(len(chain), np.int64)
    ends = np.cumsum(length)
    used = int(np.searchsorted(ends, n)) + 1
    if len(ends) < used or int(ends[used - 1]) != n:
        raise ValueError("the stream is too short")
    chain, s, begin = chain[:used], s[:used], (ends - length)[:used]
    out = np.zeros(n, np.uint8)
    plain = s < 256
    out[begin[plain]] = s[plain]
    r.at = (r.at & ~7) + int(after[chain[-1]])
    if r.at > r.end:
        raise ValueError("the stream is too short")
    if len(copy) and not plain.all():
        gap = np.zeros(len(bits), np.int64)
        gap[copy] = distance
        for at, c in zip(begin[~plain].tolist(), chain[~plain].tolist()):
            k, d = int(width_of[c]), _distance(int(gap[c]), width)
            if d > at:
                raise ValueError("a copy runs out of the image")
            out[at : at + k] = out[at - d : at - d + k] if d >= k else np.resize(out[at - d : at], k)
    return out.astype(np.uint32) << np.uint32(8) | base


def _extra_at(symbol: np.ndarray, at: np.ndarray, data: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefix symbols whose extra bits begin at these bits, and the bits behind them."""
    n = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    byte = np.minimum(at >> 3, len(data) - 5)
    word = sum(data[byte + k].astype(np.int64) << (8 * k) for k in range(4))
    x = word >> (at & 7) & (1 << n) - 1
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)).astype(np.int64) << n) + x + 1), np.minimum(at + n, last).astype(np.int32)


# --- transforms


def _average(a, b):
    return _channels(a, b, lambda x, y: (x + y) >> np.uint32(1))


def _predict_one(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """Prediction of a pixel from its left, top, top-left and top-right neighbours."""
    part = lambda p: ((p >> 24) & 255, (p >> 16) & 255, (p >> 8) & 255, p & 255)
    join = lambda q: q[0] << 24 | q[1] << 16 | q[2] << 8 | q[3]
    mean = lambda a, b: join([(x + y) >> 1 for x, y in zip(part(a), part(b))])
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    trio = list(zip(part(left), part(top), part(corner)))
    if mode == 11:
        # The estimate is left + top - corner; the nearer of both neighbours wins.
        return left if sum(abs(t - c) for _, t, c in trio) < sum(abs(a - c) for a, _, c in trio) else top
    if mode == 12:
        return join([clip(a + t - c) for a, t, c in trio])
    both = [(a + t) >> 1 for a, t, _ in trio]
    return join([clip(m + int((m - c) / 2)) for m, (_, _, c) in zip(both, trio)])


def _predict(x: np.ndarray, bits: int, modes: np.ndarray, undo: bool) -> np.ndarray:
    height, width = x.shape
    own, out = x.tolist(), []
    for y in range(height):
        row, above = [], (out if undo else own)[y - 1] if y else None
        for i in range(width):
            if y == 0:
                guess = (row if undo else own[0])[i - 1] if i else 0xFF000000
            elif i == 0:
                guess = above[0]
            else:
                now = row if undo else own[y]
                guess = _predict_one(int(modes[y >> bits, i >> bits]), now[i - 1], above[i], above[i - 1], above[i + 1] if i + 1 < width else (row if undo else own[y])[0])
            p, sign = own[y][i], 1 if undo else -1
            row.append(sum(((((p >> s) & 255) + sign * ((guess >> s) & 255)) & 255) << s for s in (0, 8, 16, 24)))
        out.append(row)
    return np.array(out, np.uint32).reshape(height, width)


def _cross(x: np.ndarray, bits: int, tiles: np.ndarray, undo: bool) -> np.ndarray:
    height, width = x.shape
    e = tiles[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v, s: (v >> np.uint32(s) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda t, c: t * c >> 5
    to_red, to_blue, red_blue = signed(e, 0), signed(e, 8), signed(e, 16)
    green, red, blue = signed(x, 8), (x >> np.uint32(16) & np.uint32(255)).astype(np.int32), (x & np.uint32(255)).astype(np.int32)
    sign = 1 if undo else -1
    new_red = red + sign * delta(to_red, green) & 255
    true_red = (new_red if undo else red).astype(np.uint8).view(np.int8).astype(np.int32)
    new_blue = blue + sign * (delta(to_blue, green) + delta(red_blue, true_red)) & 255
    return x & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


# --- documents


def encode_samples(payload: bytes) -> bytes:
    """8-bit samples as grey pixels (a palette if they are few values, else less green), WIDTH to a row, in one WebP file, or several one after the other. len(payload) > 0 is a multiple of WIDTH."""
    most, files = WIDTH * MAX_SIDE, []
    for k in range(0, len(payload), most):
        part = payload[k : k + most]
        grey = np.frombuffer(part, np.uint8)
        used = np.nonzero(np.bincount(grey, minlength=256))[0]
        out = BitWriter()
        for v, n in ((SIGNATURE, 8), (WIDTH - 1, 14), (len(part) // WIDTH - 1, 14), (0, 1), (0, 3), (1, 1)):
            out.put(v, n)
        if len(used) <= 16:
            rank = np.zeros(256, np.uint32)
            rank[used] = np.arange(len(used))
            colours = used.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
            out.put(PALETTE, 2)
            out.put(len(used) - 1, 8)
            _write_pixels(out, _minus(colours, np.concatenate((np.zeros(1, np.uint32), colours[:-1]))), len(colours), main=False)
            out.put(0, 1)
            _write_pixels(out, bundle(rank[grey].reshape(-1, WIDTH), len(used)).ravel(), WIDTH >> bundle_bits(len(used)))
        else:
            # Red and blue equal green: once it is taken off, they are 0.
            out.put(SUBTRACT_GREEN, 2)
            out.put(0, 1)
            _write_pixels(out, grey.astype(np.uint32) << np.uint32(8), WIDTH, line_copies(part), grey=True)
        body = out.bytes()
        files.append(b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2))
    return b"".join(files)


def decode_samples(media: bytes) -> bytes:
    at, parts = 0, []
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        parts.append((decode(media[at : at + size]) & np.uint32(255)).astype(np.uint8).tobytes())
        at += size
    return b"".join(parts)


def features(samples: bytes) -> str:
    """Mean, standard deviation, share of level changes along rows, and a 16-step histogram in permille."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    histogram = np.bincount(x.ravel() >> 4, minlength=16) * 1000 // x.size
    return f"{x.mean():.4f} {x.std():.4f} {(x[:, 1:] != x[:, :-1]).mean():.4f} " + ",".join(map(str, histogram))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (binary): each whole text as UTF-8, padded with zeros to a positive multiple of WIDTH, as lossless WebP.

    Null and empty texts are one row of zeros. Equal texts give equal media. Repeated rows get a row each.
    """

    def store(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                media = [encode_samples(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in raw]
                yield pa.record_batch([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(store, f"doc_id {id_type}, n_bytes long, media binary").withColumnRenamed("doc_id", id_col)


def media_digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What reading each stored form back gives: payload size and hashes, size and hash of the stored form, features."""

    def read(batches):
        for b in batches:
            rows = []
            for m in b.column(2).to_pylist():
                p = decode_samples(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
            kinds = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
            columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)]
            yield pa.record_batch([b.column(0), b.column(1), *columns], names=["doc_id", "n_bytes", *(n for n, _ in kinds)])

    id_type = media.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(id_col).alias("doc_id"), "n_bytes", "media").mapInArrow(read, schema).withColumnRenamed("doc_id", id_col)
