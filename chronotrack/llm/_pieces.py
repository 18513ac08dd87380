"""The pieces of a public SentencePiece vocabulary, and all pieces inside many short strings at once."""

from __future__ import annotations

import numpy as np

MARK = "▁"
STRAY = "\ud800"
#: Slots of each of the two hash tables, as a power of two.
_SLOTS = 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _spread(c: np.ndarray) -> np.ndarray:
    x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def code_points(strings: list[str], width: int) -> np.ndarray:
    """Matrix of code points, zero after each string's end."""
    raw = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(len(strings), width)


class Pieces:
    """Ids, whole-number scores and a two-table hash of the ordinary pieces (no control, unknown or byte pieces)."""

    def __init__(self, strings: list[str], scores: list[int], ids: list[int], byte_ids: list[int], size: int):
        self.strings, self.ids, self.byte_ids, self.size = strings, np.array(ids, np.int64), byte_ids, size
        self.score = np.array(scores, np.int64)
        #: Score of one character outside the vocabulary: below any piece, as the library has it.
        self.unknown_score = int(self.score.min()) - 10
        self.longest = max(map(len, strings))
        self.index = {s: k for k, s in enumerate(strings)}
        self.alphabet = {s for s in strings if len(s) == 1}
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)), dtype=np.uint64)
        self._build()

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        use = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        # Runs of spaces are pieces that no best path uses (their score is a billion below the rest); without them no piece crosses a unit.
        use = [i for i in use if MARK not in p.id_to_piece(i)[1:]]
        strings = [p.id_to_piece(i) for i in use]
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(strings, [int(round(p.get_score(i))) for i in use], use, byte_ids, p.get_piece_size())

    def _build(self) -> None:
        h = self.hashes(code_points(self.strings, self.longest))
        n = np.array([len(s) for s in self.strings])
        key = self.part(h, np.arange(len(n)), np.zeros(len(n), np.int64), n)
        assert len(np.unique(key)) == len(key)
        self.key = [np.zeros(1 << _SLOTS, np.uint64) for _ in range(2)]
        self.at = [np.full(1 << _SLOTS, -1, np.int32) for _ in range(2)]
        for k, x in enumerate(key):
            item, which = (x, k), 0
            for turn in range(500):
                slot = int((int(item[0]) * int(_MIX[which]) & (1 << 64) - 1) >> (64 - _SLOTS))
                old = (self.key[which][slot], int(self.at[which][slot]))
                self.key[which][slot], self.at[which][slot] = item[0], item[1]
                if old[1] < 0:
                    break
                item, which = old, 1 - which
            else:
                raise ValueError("hash tables too small for this vocabulary")

    @staticmethod
    def hashes(points: np.ndarray) -> np.ndarray:
        """Prefix hashes of each row, position by position."""
        x = _spread(points)
        h = np.zeros((x.shape[0], x.shape[1] + 1), np.uint64)
        for i in range(x.shape[1]):
            h[:, i + 1] = h[:, i] * _BASE + x[:, i]
        return h

    def part(self, h: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return h[row, start + n] - h[row, start] * self.powers[n]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 if there is none."""
        shift = np.uint64(64 - _SLOTS)
        a = (key * _MIX[0]) >> shift
        b = (key * _MIX[1]) >> shift
        return np.where(self.key[0][a] == key, self.at[0][a], np.where(self.key[1][b] == key, self.at[1][b], -1))

    def edges(self, points: np.ndarray):
        """For each end position 1..width: list of (piece length, index of the piece in each row or -1), longest first."""
        h = self.hashes(points)
        for end in range(1, points.shape[1] + 1):
            yield end, [(n, self.find(h[:, end] - h[:, end - n] * self.powers[n])) for n in range(min(end, self.longest), 0, -1)]


def units(text: str) -> list[str]:
    """The strings between which no piece can run: a new one begins at each space and at each line end.

    A unit stands for itself with MARK before it, unless it begins with a line end: then it stands for itself. A MARK
    in the text becomes STRAY, which valid text cannot hold and which is no piece, so it falls back to bytes.
    """
    if MARK in text:
        text = text.replace(MARK, STRAY)
    return text.replace("\n", " \n").split(" ")


def full(unit: str) -> str:
    return unit if unit[:1] == "\n" else MARK + unit


def utf8(c: str) -> bytes:
    return (MARK if c == STRAY else c).encode()
