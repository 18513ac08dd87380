"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks."""

from __future__ import annotations

import functools
import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrack.llm._batches import forgettable, parts, release
from chronotrack.llm._pieces import DEFAULT_MODEL, MARK, Pieces, code_points, full, units, utf8
from chronotrack.llm._store import write_table

NEVER = -(1 << 60)
#: Characters of a chunk, and of the largest document that is encoded in one piece.
CHUNK = 32768
#: Chunks whose transfer matrices are multiplied together before the scan.
BLOCK = 256
#: Bytes of units and their ids kept per Python worker between rows, with ENTRY bytes for the objects around each.
CACHE, ENTRY = 48_000_000, 200
#: Units up to this many characters are solved together as arrays.
SHORT = 40


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.states = pieces.longest
        #: Ids of each unit as little-endian 32-bit numbers.
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.scores = np.append(pieces.score, NEVER)
        self.bytes = [b""] * pieces.size
        #: Score by id; that of an unknown character stands at its first byte.
        self.worth = np.zeros(pieces.size, np.int64)
        for b, i in enumerate(pieces.byte_ids):
            self.bytes[i] = bytes([b])
            self.worth[i] = 0 if b >> 6 == 2 else pieces.unknown_score
        self.worth[pieces.ids] = pieces.score
        for s, i in zip(pieces.strings, pieces.ids.tolist()):
            self.bytes[i] = s.replace(MARK, " ").encode()

    def spell(self, c: str) -> list[int]:
        return [self.p.byte_ids[b] for b in utf8(c)]

    def forward(self, s: str, body: int, entry: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """Best score of reaching each position of s by pieces that begin before ``body``; entry: scores of the first positions.

        Of equal scores the piece that begins first stays. Back pointers: (start, index of the piece or -1).
        """
        get, score, longest = self.p.index.get, self.scores, self.p.longest
        best, back = [NEVER] * (len(s) + 1), [(-1, -1)] * (len(s) + 1)
        best[: len(entry)] = entry
        for i in range(body):
            at = best[i]
            if at <= NEVER // 2:
                continue
            for n in range(1, min(longest, len(s) - i) + 1):
                k = get(s[i : i + n], -1)
                if k < 0 and n > 1:
                    continue
                x = at + (int(score[k]) if k >= 0 else self.p.unknown_score)
                if x > best[i + n]:
                    best[i + n], back[i + n] = x, (i, k)
        return best, back

    def trace(self, s: str, back: list[tuple[int, int]], end: int, start: int) -> list[int]:
        parts = []
        while end > start:
            begin, k = back[end]
            parts.append([int(self.p.ids[k])] if k >= 0 else self.spell(s[begin]))
            end = begin
        assert end == start
        return list(chain.from_iterable(reversed(parts)))

    def scalar(self, u: str) -> bytes:
        u = full(u)
        return np.array(self.trace(u, self.forward(u, len(u), [0])[1], len(u), 0), "<i4").tobytes()

    def learn(self, wanted: set[str]) -> None:
        """Put units into the cache; short ones are solved together, position by position."""
        short = sorted((u for u in wanted if len(u) < SHORT), key=len)
        for u in wanted:
            if len(u) >= SHORT:
                self.cache[u] = self.scalar(u)
        self.held += sum(ENTRY + 5 * len(u) for u in wanted)
        for k in range(0, len(short), 8192):
            self._together(short[k : k + 8192])

    def _together(self, block: list[str]) -> None:
        whole = list(map(full, block))
        n = np.fromiter(map(len, whole), np.int64, len(whole))
        rows, width = len(whole), int(n.max())
        best = np.full((width + 1, rows), NEVER, np.int64)
        best[0] = 0
        size = np.zeros((width + 1, rows), np.int8)
        which = np.full((width + 1, rows), -1, np.int32)
        for end, options in self.p.edges(code_points(whole, width)):
            top, length, piece = best[end], size[end], which[end]
            for long, k in options:
                x = best[end - long] + self.scores[k]
                if long == 1:
                    x = np.where(k < 0, best[end - 1] + self.p.unknown_score, x)
                better = x > top
                np.copyto(top, x, where=better)
                np.copyto(length, long, where=better)
                np.copyto(piece, k, where=better)
        at, steps, row = n.copy(), [], np.arange(rows)
        while (live := at > 0).any():
            steps.append(np.where(live, which[at, row], -2))
            at = at - np.where(live, size[at, row], 0)
        path = np.array(steps[::-1]).T
        used = path >= 0
        ends = np.cumsum(used.sum(axis=1)) * 4
        flat = self.p.ids[path[used]].astype("<i4").tobytes()
        odd = (path == -1).any(axis=1)
        self.cache.update(zip(block, [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]))
        for r in np.nonzero(odd)[0].tolist():
            self.cache[block[r]] = self.scalar(block[r])

    def ready(self, wanted: set[str]) -> None:
        """Have all these units in the cache; a full cache is emptied first."""
        if new := wanted.difference(self.cache):
            if self.held > CACHE:
                self.cache.clear()
                self.held = 0
                new = wanted
            self.learn(new)

    def join(self, us: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, us)), "<i4")

    def encode(self, us: list[str]) -> np.ndarray:
        self.ready(set(us))
        return self.join(us)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; the units of all of them are solved together."""
        group = [units(t) if t else [] for t in texts]
        self.ready(set(chain.from_iterable(group)))
        return list(map(self.join, group))

    def score(self, ids: np.ndarray) -> int:
        return int(self.worth[ids].sum())

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()[1:]

    # Chunks of giant documents. A state is the number of a chunk's first characters that a piece of the chunk before
    # it has covered already; a transfer matrix holds the best score for each state at the start and at the end.

    def cut(self, body: str) -> tuple[int, int]:
        """First and last place where a unit begins, (-1, -1) if none does."""
        at = [max(body.find(c), -1) for c in (MARK, "\n")]
        first = min((a for a in at if a >= 0), default=-1)
        return first, max(body.rfind(MARK), body.rfind("\n"))

    def matrix(self, body: str, ahead: str) -> np.ndarray:
        s, m = self.states, np.full((self.states, self.states), NEVER, np.int64)
        first, last = self.cut(body)
        if first < 0:
            for e in range(min(s, len(body) + 1)):
                best, _ = self.forward(body + ahead, len(body), [NEVER] * e + [0])
                m[e, : 1 + len(ahead)] = best[len(body) : len(body) + s]
            return m
        middle = body[first:last]
        inner = self.score(self.encode(self.split(middle))) if middle else 0
        tail, _ = self.forward(body[last:] + ahead, len(body) - last, [0])
        tail = np.array(tail[len(body) - last :][:s], np.int64)
        for e in range(min(s, first + 1)):
            head = self.forward(body[:first], first, [NEVER] * e + [0])[0][first] if e < first else 0
            m[e, : len(tail)] = np.where(tail <= NEVER // 2, NEVER, head + inner + tail)
        return m

    @staticmethod
    def split(joined: str) -> list[str]:
        """Units of a string that begins with one."""
        return joined.replace("\n", MARK + "\n").split(MARK)[1:]

    def chunk_ids(self, body: str, ahead: str, entry: int, leave: int) -> list[int]:
        first, last = self.cut(body)
        if first < 0:
            _, back = self.forward(body + ahead, len(body), [NEVER] * entry + [0])
            return self.trace(body + ahead, back, len(body) + leave, entry)
        head = self.trace(body[:first], self.forward(body[:first], first, [NEVER] * entry + [0])[1], first, entry) if entry < first else []
        middle = self.encode(self.split(body[first:last])).tolist() if last > first else []
        tail = body[last:] + ahead
        _, back = self.forward(tail, len(body) - last, [0])
        return head + middle + self.trace(tail, back, len(body) - last + leave, 0)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; scores are whole numbers, so it is exactly associative."""
    x = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(x <= NEVER // 2, NEVER, x)


@functools.lru_cache(2)
def encoder(model: str) -> Encoder:
    release()
    return Encoder(Pieces.load(model))


forgettable(encoder.cache_clear)

def chunks(joined: str, size: int, longest: int) -> list[tuple[str, str]]:
    cuts = list(range(0, len(joined), size))
    if len(cuts) > 1 and len(joined) - cuts[-1] < longest:
        cuts.pop()
    ends = [*cuts[1:], len(joined)]
    return [(joined[a:b], joined[b : b + longest - 1]) for a, b in zip(cuts, ends)]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """id, ids (array of int), score (long): the best segmentation of each whole text under the vocabulary's piece scores.

    Pieces are those of a public SentencePiece model; the best path by the sum of their scores is that of its
    unigram rule (Viterbi), with a space put before the text, spaces kept as U+2581 and characters outside the
    vocabulary spelled as bytes. A MARK character in a text is spelled as bytes too, so decoding is lossless.

    Texts of over ``chunk`` characters become chunk rows dealt over all tasks: each chunk yields its transfer matrix,
    blocks of matrices are multiplied, a scan over blocks and then inside each block gives the states at every
    boundary, and every chunk traces its own pieces back. Of several best paths a giant text may get another one than a
    sequential pass would where a chunk ends inside a unit; the score is the same. Null and empty texts have no ids and score 0. Repeated rows get a row each; a null id stays null.
    """
    id_type, small, giant = _split(docs, id_col, text_col, chunk)

    def whole(batches):
        enc = encoder(model)
        for b in batches:
            for part in parts(b, 1):
                out = enc.encode_many(part.column(1).to_pylist())
                yield _ids_batch([part.column(0)], ["doc_id"], out, list(map(enc.score, out)))

    done = small.mapInArrow(whole, f"doc_id {id_type}, ids array<int>, score long")
    if giant is not None:
        done = done.unionByName(_giant(giant, id_type, model, chunk))
    return done.withColumnRenamed("doc_id", id_col)


def _split(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[str, DataFrame, DataFrame | None]:
    """Type of the id, rows that are encoded in one piece, and the giant ones if there are any."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    giant = rows.where(F.length("text") > chunk)
    some = not giant.isEmpty()
    return docs.schema[id_col].dataType.simpleString(), rows.where(F.col("text").isNull() | (F.length("text") <= chunk)), giant.withColumn("row", F.monotonically_increasing_id()) if some else None


def _ids_batch(columns, names, out, score):
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out, np.zeros(0, np.int32)]).astype(np.int32)))
    return pa.record_batch([*columns, ids, pa.array(score, pa.int64())], names=[*names, "ids", "score"])


def plain(x: bytes) -> str:
    return x.decode("utf-8", "surrogatepass")


def _giant(rows: DataFrame, id_type: str, model: str, chunk: int) -> DataFrame:
    def cut(batches):
        enc = encoder(model)
        for b in batches:
            for doc, text, row in zip(b.column(0), b.column(1), b.column(2)):
                found = chunks("".join(map(full, units(text.as_py()))), chunk, enc.states)
                for k in range(0, len(found), 64):
                    some = found[k : k + 64]
                    n = len(some)
                    body, ahead = (pa.array([x[i].encode("utf-8", "surrogatepass") for x in some], pa.binary()) for i in (0, 1))
                    ids, rows = pa.array([doc.as_py()] * n, b.column(0).type), pa.array([row.as_py()] * n, pa.int64())
                    yield pa.record_batch([ids, rows, pa.array(range(k, k + n), pa.int64()), body, ahead], names=["doc_id", "row", "chunk", "body", "ahead"])

    def transfer(batches):
        enc = encoder(model)
        for b in batches:
            for part in parts(b, 3):
                m = [enc.matrix(plain(x.as_py()), plain(y.as_py())).tobytes() for x, y in zip(part.column(3), part.column(4))]
                yield pa.record_batch([part.column(1), part.column(2), pa.array(m, pa.binary())], names=["row", "chunk", "m"])

    def read(x: bytes) -> np.ndarray:
        m = np.frombuffer(x, np.int64)
        return m.reshape(round(len(m) ** 0.5), -1)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [read(x) for x in pdf.sort_values("chunk").m]
        return pd.DataFrame({"row": [pdf.row[0]], "block": [pdf.block[0]], "m": [functools.reduce(times, ms).tobytes()]})

    def walk(ms: list[np.ndarray], v: np.ndarray, leave: int) -> tuple[list[np.ndarray], list[int]]:
        """Scores before each matrix, and the state after each one on the best path that ends in ``leave``."""
        before = []
        for m in ms:
            before.append(v)
            v = (v[:, None] + m).max(axis=0)
        after = []
        for v, m in zip(before[::-1], ms[::-1]):
            after.append(leave)
            leave = int((v + m[:, leave]).argmax())
        return before, after[::-1]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        ms = [read(x) for x in pdf.m]
        start = np.full(len(ms[0]), NEVER, np.int64)
        start[0] = 0
        before, after = walk(ms, start, 0)
        return pd.DataFrame({"row": pdf.row, "block": pdf.block, "v": [x.tobytes() for x in before], "leave": after})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        ms = [read(x) for x in pdf.m]
        before, after = walk(ms, np.frombuffer(pdf.v[0], np.int64), int(pdf.leave[0]))
        entry = [int((before[0] + ms[0][:, after[0]]).argmax()), *after[:-1]]
        score = [int(m[a, b]) for m, a, b in zip(ms, entry, after)]
        return pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "entry": entry, "leave": after, "score": score})

    def trace(batches):
        enc = encoder(model)
        for b in batches:
            for part in parts(b, 3):
                out = [np.array(enc.chunk_ids(plain(x.as_py()), plain(y.as_py()), i.as_py(), e.as_py()), np.int32) for x, y, i, e in zip(*part.columns[3:7])]
                yield _ids_batch(part.columns[:3], ["doc_id", "row", "chunk"], out, part.column(7).to_pylist())

    pieces = write_table(rows.mapInArrow(cut, f"doc_id {id_type}, row long, chunk long, body binary, ahead binary"), "chunks")
    dealt = pieces.repartition("row", "chunk")
    moved = write_table(dealt.mapInArrow(transfer, "row long, chunk long, m binary").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("long")), "transfers")
    blocks = moved.groupBy("row", "block").applyInPandas(product, "row long, block long, m binary")
    starts = blocks.groupBy("row").applyInPandas(scan, "row long, block long, v binary, leave int")
    states = moved.join(starts, ["row", "block"]).groupBy("row", "block").applyInPandas(inside, "row long, chunk long, entry int, leave int, score long")
    ready = pieces.join(states, ["row", "chunk"]).select("doc_id", "row", "chunk", "body", "ahead", "entry", "leave", "score")
    traced = ready.mapInArrow(trace, f"doc_id {id_type}, row long, chunk long, ids array<int>, score long")
    found = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("c"), F.sum("score").alias("score"))
    return found.select("doc_id", F.flatten(F.col("c.ids")).alias("ids"), "score")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """id, text of each row of ids; no ids (null or empty): the empty text. Repeated rows get a row each; a null id stays null."""

    def read(batches):
        enc = encoder(model)
        for b in batches:
            for part in _id_parts(b):
                texts = [enc.decode(x) if len(x) else "" for x in _ids(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    found = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(read, f"doc_id {id_type}, text string")
    return found.withColumnRenamed("doc_id", id_col)


def _id_parts(b: pa.RecordBatch, limit: int = 500_000):
    """Slices of ``b`` (column 1: lists of ids) with about ``limit`` ids each."""
    n = pc.list_value_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for rows in np.split(np.arange(len(n)), np.nonzero(np.diff(np.cumsum(n) // limit))[0] + 1):
        if len(rows):
            yield b.slice(int(rows[0]), len(rows))


def _ids(column: pa.ListArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).astype("<i4") if x.is_valid else np.zeros(0, "<i4") for x in column]


DIGEST = "n_ids long, score long, ids_sha256 string, text_sha256 string"


def _digest_batch(enc: Encoder, doc, out: list[np.ndarray], score) -> pa.RecordBatch:
    own = [hashlib.sha256(x.astype("<i4", copy=False).tobytes()).hexdigest() for x in out]
    text = [hashlib.sha256((enc.decode(x) if len(x) else "").encode()).hexdigest() for x in out]
    return pa.record_batch([doc, pa.array([len(x) for x in out], pa.int64()), score, pa.array(own, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_ids", "score", "ids_sha256", "text_sha256"])


def digest(encoded: DataFrame, id_col: str = "doc_id", model: str = DEFAULT_MODEL) -> DataFrame:
    """id, n_ids, score, ids_sha256 (of the ids as little-endian 32-bit numbers), text_sha256 (of the decoded text)."""

    def read(batches):
        enc = encoder(model)
        for b in batches:
            for part in _id_parts(b):
                yield _digest_batch(enc, part.column(0), _ids(part.column(1)), part.column(2))

    id_type = encoded.schema[id_col].dataType.simpleString()
    found = encoded.select(F.col(id_col).alias("doc_id"), "ids", "score")
    return found.mapInArrow(read, f"doc_id {id_type}, {DIGEST}").withColumnRenamed("doc_id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """digest(encode_documents(docs)), with the ids of all but giant texts digested in the Python worker that encodes them.

    Nulls, empty and repeated rows as in encode_documents.
    """
    id_type, small, giant = _split(docs, id_col, text_col, chunk)

    def whole(batches):
        enc = encoder(model)
        for b in batches:
            for part in parts(b, 1):
                out = enc.encode_many(part.column(1).to_pylist())
                yield _digest_batch(enc, part.column(0), out, pa.array(list(map(enc.score, out)), pa.int64()))

    done = small.mapInArrow(whole, f"doc_id {id_type}, {DIGEST}")
    if giant is not None:
        done = done.unionByName(digest(_giant(giant, id_type, model, chunk), "doc_id", model))
    return done.withColumnRenamed("doc_id", id_col)
