"""Near copies by the exact Jaccard similarity of five-word shingles, retrieved by MinHash bands, over SimHash components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import PART, parts, release
from chronotrack.llm._components import connected_components
from chronotrack.llm._skew import attach
from chronotrack.llm._store import write_table
from chronotrack.llm.simhash import LOWER, simhash_components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 agrees in all rows of some band with probability 1 - (1 - 0.8^5)^32 > 0.99999.
BANDS, ROWS = 32, 5
#: Rows of the MinHash sketch in which a pair must agree to be verified: at similarity 0.8 fewer do with probability 1e-9.
AGREE = 96
#: A bucket of up to this many members is joined with itself; members of a larger one are compared in blocks of BLOCK.
SMALL_BUCKET, BLOCK = 8, 256
#: Shingles that are looked up together when two blocks are compared.
TOGETHER = 1 << 18
_random = np.random.default_rng(8)
_FACTOR = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> set[bytes]:
    """The different runs of five words; fewer words are one shingle, no words none."""
    words = text.translate(LOWER).split()
    if len(words) <= SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both > 0 and both >= SIMILARITY * (len(a) + len(b) - both)


def sketch(found: set[bytes]) -> tuple[np.ndarray, bytes]:
    """Key of each band, and one byte of each row."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 4096):
        np.minimum(least, (h[k : k + 4096, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    x = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    return (x ^ (x >> np.uint64(29))).view(np.int64), ((least * _MIX.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)


def _digests(batches):
    release()
    for b in batches:
        for part in parts(b, 1):
            found = [hashlib.md5(b" ".join((t or b"").translate(LOWER).split())).digest() for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], names=["node", "same"])


def _sketched(batches):
    release()
    for b in batches:
        for part in parts(b, 2):
            row, found = [], []
            for k, t in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                if some := shingles(t or b""):
                    row.append(k)
                    found.append(sketch(some))
            at, keys = pa.array(row, pa.int64()), np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), lists, pa.array([s for _, s in found], pa.binary())], names=["node", "comp", "keys", "sketch"])


def _likely(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(f"value_{side}").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for side in "ab")
        yield b.select(["a", "b", "comp_a", "comp_b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both blocks that meet in a group; twice the same when a block meets itself."""
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    left = np.flatnonzero(own == i[0])
    return left, left if j[0] == i[0] else np.flatnonzero(own != i[0])


def _between(table: pa.Table) -> pa.Table:
    """Members of a bucket's two blocks (or of one) whose sketch agrees with one of a different component there."""
    comp = table.column("comp").to_numpy()
    sig = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    left, right = _sides(table)
    close = np.zeros(len(comp), bool)
    for k in range(0, len(left), 64):
        some = left[k : k + 64]
        met = (agreement(sig[some], sig[right]) >= AGREE) & (comp[some][:, None] != comp[right][None, :])
        close[some] |= met.any(axis=1)
        close[right] |= met.any(axis=0)
    return table.select(GROUP).filter(pa.array(close))


def _runs(rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in runs of up to TOGETHER shingles, or of one row."""
    cuts = np.flatnonzero(np.diff((np.cumsum(size[rows]) - size[rows]) // TOGETHER)) + 1
    yield from np.split(rows, cuts)


def _joined(table: pa.Table) -> pa.Table:
    """Links between components by the similar pairs of two blocks: of all pairs, those that join what was not yet joined, so fewer than members."""
    comp = table.column("comp").to_numpy()
    found = []
    for t in table.column("text").cast(pa.binary()):
        some = shingles(t.as_py())
        found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some))))
    size = np.fromiter(map(len, found), np.int64, len(found))
    top, out = comp.copy(), []
    left, right = _sides(table)
    for some in _runs(right, size) if len(left) and len(right) else ():
        values, at = np.unique(np.concatenate([found[k] for k in some]), return_inverse=True)
        starts = np.cumsum(size[some]) - size[some]
        for a in left:
            own = np.searchsorted(values, found[a]).clip(0, len(values) - 1)
            mark = np.zeros(len(values), np.int32)
            mark[own[values[own] == found[a]]] = 1
            both = np.add.reduceat(mark.take(at), starts)
            hit = some[(both >= SIMILARITY * (size[a] + size[some] - both)) & (top[some] != top[a])]
            for other, k in zip(*np.unique(top[hit], return_index=True)):
                out.append((comp[a], comp[hit[k]]))
                top[top == other] = top[a]
    return pa.table(list(np.array(out, np.int64).reshape(-1, 2).T), names=["a", "b"])


def _verified(batches):
    release()
    for b in batches:
        keep, size = [], 0
        kept: dict[bytes, set[bytes]] = {}
        left, right = b.column("value_a").cast(pa.binary()), b.column("value_b").cast(pa.binary())
        for k in range(b.num_rows):
            if len(kept) > 50 or size > PART // 2:
                kept.clear()
                size = 0
            x, y = left[k].as_py(), right[k].as_py()
            for text in (x, y):
                if text not in kept:
                    kept[text] = shingles(text)
                    size += len(text)
            if similar(kept[x], kept[y]):
                keep.append(k)
        part = b.take(pa.array(keep, pa.int64()))
        yield pa.record_batch([part.column("comp_a"), part.column("comp_b")], names=["a", "b"])


PAIR = ["a", "b", "comp_a", "comp_b"]
GROUP = ["band", "key", "i", "j", "node", "comp", "own"]


def _with(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """pairs with value_a and value_b. A node in many pairs makes its partition large, which the adaptive skew join splits."""
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("node").alias(side), F.col(value).alias(f"value_{side}")), side)
    return pairs.select(*PAIR, "value_a", "value_b")


def _links(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, close: DataFrame | None = None) -> DataFrame:
    """Edges between components: of the pairs (a, b, comp_a, comp_b) those whose sketches agree and whose texts reach SIMILARITY.

    close: members of large buckets, see ``_close``; their pairs are formed and verified inside the kernel.
    """
    kind = "a long, b long, comp_a long, comp_b long"
    pairs = write_table(pairs.select(*PAIR).distinct(), "near-pairs")
    likely = write_table(_with(pairs, sketches, "sketch").mapInArrow(_likely, kind), "near-likely")
    ends = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node")))
    if close is not None:
        close = write_table(close, "near-close")
        ends = ends.union(close.select("node"))
    needed = write_table(texts.join(ends.distinct(), "node", "left_semi").select("node", "text"), "near-needed")
    found = _with(likely, needed, "text").mapInArrow(_verified, "a long, b long")
    if close is not None:
        found = found.union(close.join(needed, "node").groupBy("band", "key", "i", "j").applyInArrow(_joined, "a long, b long"))
    return found.distinct()


def _small(left: DataFrame) -> DataFrame:
    """Pairs of different components that share a small bucket."""
    small = left.where(F.col("n") <= SMALL_BUCKET)
    x, y = (small.select("band", "key", F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
    return x.join(y, ["band", "key"]).where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))).select(*PAIR)


def _close(left: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of large buckets, dealt into blocks that meet in pairs; of each meeting only those near to another component leave the kernel, without their pairs."""
    large = left.where(F.col("n") > SMALL_BUCKET).join(sketches.select("node", "sketch"), "node")
    blocks = F.ceil(F.col("n") / BLOCK)
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    dealt = large.select("band", "key", "node", "comp", "sketch", "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    kind = "band int, key long, i long, j long, node long, comp long, own long"
    return dealt.groupBy("band", "key", "i", "j").applyInArrow(_between, kind)


def _merge(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with comp replaced by its component in merged (node, component)."""
    sizes = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    moved = write_table(sizes.join(merged.withColumnRenamed("node", "comp"), "comp"), "near-moved")
    found = attach(rows, moved, ["comp"], "n", F.col("node"))
    return found.withColumn("comp", F.coalesce("component", "comp")).select(*rows.columns)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id of each row: components of the SimHash links and of the pairs with shingle similarity 0.8 or more.

    Texts of equal words have equal fingerprints, so one stands for all. MinHash bands retrieve; in each bucket all
    members are first compared with its smallest, which joins groups of copies without pairs; then the members of a bucket
    that are still in different components are compared by their sketches, those of a large bucket in blocks dealt over
    the tasks. Every link is verified on the texts; in a large bucket all pairs are compared inside the kernel, and only
    links that join components leave it. No words: no shingle, so only SimHash links. Null ids keep their SimHash
    component.
    """
    base = write_table(simhash_components(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), "component_id"), "near-base")
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).where(F.col("node").isNotNull())
    # A repeated id is one node with all its texts.
    same = rows.mapInArrow(_digests, "node long, same binary").groupBy("same").agg(F.min("node").alias("node")).select("node").distinct()
    label = base.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("node")).agg(F.min("component_id").cast("long").alias("comp"))
    texts = write_table(rows.join(same, "node").join(label, "node").groupBy("node", "comp", F.md5("text").alias("same")).agg(F.min("text").alias("text")).drop("same"), "near-texts")
    sketches = write_table(texts.select("node", "comp", "text").mapInArrow(_sketched, "node long, comp long, keys array<long>, sketch binary"), "near-sketches")
    keys = sketches.select("node", "comp", F.posexplode("keys").alias("band", "key"))

    def mixed(keys: DataFrame) -> DataFrame:
        agg = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("comp", "node")).alias("hub"))
        return write_table(agg.where("low < high").select("band", "key", "n", "hub"), "near-buckets")

    members = attach(keys, mixed(keys), ["band", "key"], "n", F.col("node")).where(F.col("n").isNotNull())
    stars = members.where(F.col("comp") != F.col("hub.comp")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("comp").alias("comp_a"), F.col("hub.comp").alias("comp_b"))
    first = write_table(_links(stars, texts, sketches), "near-links")
    keys = _merge(sketches.select("node", "comp", "keys"), write_table(connected_components(first), "near-parts"))
    keys = write_table(keys.select("node", "comp", F.posexplode("keys").alias("band", "key")), "near-keys")
    left = attach(keys, mixed(keys), ["band", "key"], "n", F.col("node")).where(F.col("n").isNotNull()).select("band", "key", "n", "node", "comp")
    left = write_table(left, "near-left")
    second = _links(_small(left), texts, sketches, _close(left, sketches))
    parts_of = connected_components(first.union(second))
    sizes = base.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    moved = write_table(sizes.join(parts_of.withColumnRenamed("node", "component_id"), "component_id"), "near-moved")
    found = attach(base, moved, ["component_id"], "n", F.col("doc_id"))
    return found.select(F.col("doc_id").alias(id_col), F.coalesce("component", "component_id").alias("component_id"))
