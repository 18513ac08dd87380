"""SimHash near-duplicates found through Golay-code keys of fingerprint segments."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import parts, release
from chronotrack.llm._components import connected_components
from chronotrack.llm._skew import attach
from chronotrack.llm._store import write_table

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Segments of the 64-bit fingerprint: (first bit, bits). A Golay word has 23 bits; the last segment is padded with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
MAX_BITS = 2
#: A bucket of up to this many fingerprints is joined with itself; a larger one is resolved through midpoints.
SMALL_BUCKET = 8


def fingerprint(text: bytes) -> int:
    """64 bits: bit i is set if over half of the XXH64 values (seed 42) of the 3-word shingles have it set."""
    words = text.translate(LOWER).split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= 3:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-3] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[2:].tolist())], dtype="<u8")
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    release()
    for b in chain.from_iterable(parts(whole, 1) for whole in batches):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each byte position's values modulo the generator, and the error pattern of each remainder."""
    power = np.zeros(23, np.int64)
    x = 1
    for i in range(23):
        power[i] = x
        x <<= 1
        if x >> 11:
            x ^= GENERATOR
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    table = np.zeros((3, 256), np.int64)
    for k in range(3):
        for j in range(min(8, 23 - 8 * k)):
            table[k] ^= bits[:, j] * power[8 * k + j]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[power[a]] = 1 << a
        for b in range(a):
            error[power[a] ^ power[b]] = 1 << a | 1 << b
            for c in range(b):
                error[power[a] ^ power[b] ^ power[c]] = 1 << a | 1 << b | 1 << c
    return table, error


_BYTE, _ERROR = _syndromes()


def golay_index(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the only codeword within 3 bits of each 23-bit word."""
    s = _BYTE[0][x & 255] ^ _BYTE[1][x >> 8 & 255] ^ _BYTE[2][x >> 16 & 127]
    return (x ^ _ERROR[s]) >> 11


def golay_keys(fp: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, one row each; repeats are -1.

    Of at most 2 differing bits, one of three segments has none (pigeonhole). Scheme i asks that segment i agrees
    and that segment i + 1 shares a codeword index: a word's indices are those of the word itself and of all words one
    bit away (1 or 6 different ones), and two words within 2 bits have a word between them that is one bit from both.
    """
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys = []
    for i in range(3):
        j = (i + 1) % 3
        near = np.stack([golay_index(seg[j]), *(golay_index(seg[j] ^ (1 << b)) for b in range(SEGMENTS[j][1]))], axis=1)
        near.sort(axis=1)
        k = (np.int64(i) << 40) | (seg[i][:, None] << 12) | near
        k[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        keys.append(k)
    return np.concatenate(keys, axis=1)


def _keyed(batches):
    for b in batches:
        fp = b.column(1).to_numpy(zero_copy_only=False)
        k = golay_keys(fp)
        row, col = np.nonzero(k >= 0)
        yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(fp[row]), pa.array(k[row, col])], names=["node", "fp", "key"])


def links(prints: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) of a graph whose components are those of all pairs of fingerprints at MAX_BITS or fewer.

    ``prints``: node, fp, one row per different fingerprint. Small buckets of equal key are joined with themselves and
    verified bit by bit. In a larger bucket each fingerprint stands under itself and its 64 neighbours at one bit;
    those that meet there are at 2 bits or fewer, and any two at 2 bits or fewer do meet, so one edge to the
    smallest node replaces all pairs, and no meeting place has over 65 members.
    """
    keyed = prints.select("node", "fp").mapInArrow(_keyed, "node long, fp long, key long")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = write_table(keyed.join(counts, "key"), "golay-buckets")
    small = shared.where(F.col("members") <= small_bucket).select("key", "node", "fp")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near)
    pairs = pairs.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    large = shared.where(F.col("members") > small_bucket).select("node", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    spots = large.select("node", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("spot"))
    hubs = spots.groupBy("spot").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = spots.join(hubs, "spot").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Fewer than 3 words: the whole sequence is one shingle; no words, an empty or a null text: fingerprint zero, linked
    like any other. Repeated rows each get a row. A null id takes part under its fingerprint but is never a
    component_id unless all ids of the fingerprint are null, which then stay alone with null. Other columns are
    ignored; empty input gives no rows.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = write_table(rows.mapInArrow(_fingerprints, schema), "simhash")
    prints = write_table(rows.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"), F.count(F.lit(1)).alias("n")), "prints")
    parts = connected_components(links(prints.where("node is not null")))
    prints = write_table(prints.join(parts, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")), "print-components")
    found = attach(rows, prints, ["fp"], "n", F.col("doc_id"))
    return found.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
