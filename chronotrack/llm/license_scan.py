"""License notices: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
#: Least probability that a window which holds a template's required shingles shares a band with it.
RECALL = 0.9999
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CACHE = 400_000
#: Bytes of the texts that are scanned together.
TOGETHER = 1_000_000
MATCHES = "array<struct<template:string,first_word:long,containment:double>>"

#: Public licence notices: the words to look for (fixed values).
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def words(text: str | bytes) -> list[bytes]:
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def bands_for(similarity: float) -> int:
    """Bands of one row each so that sets of this Jaccard similarity share one with probability RECALL."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - similarity)))


class Group:
    """Templates of one shingle size and one size class: ``step`` shingles between windows of ``length`` shingles.

    A class holds templates of more than size / 2 and up to size different shingles; a window begins every size / 2
    shingles and is 1.5 sizes long, so it holds any stretch of size shingles whole.
    """

    def __init__(self, shingle: int, size: int, rng: np.random.Generator):
        self.shingle, self.size = shingle, size
        self.step = max(1, size // 2)
        self.length = 1 if size == 1 else size + self.step
        least = size // 2 + 1
        required = math.ceil(CONTAINMENT * least - 1e-9)
        self.bands = bands_for(required / (self.length + least - required) if size > 1 else 1.0)
        self.multiply = rng.integers(1, 1 << 63, self.bands, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64)
        self.templates: list[tuple[str, frozenset]] = []
        self.signatures = np.zeros((0, self.bands), np.uint64)

    def values(self, h: np.ndarray, band: int) -> np.ndarray:
        return h * self.multiply[band] + self.add[band]

    def put(self, name: str, shingles: frozenset, h: np.ndarray) -> None:
        self.templates.append((name, shingles))
        self.signatures = np.vstack((self.signatures, [[self.values(h, b).min() for b in range(self.bands)]]))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(window, template) pairs that share a band."""
        windows = max(1, -(-(len(h) - self.length) // self.step) + 1)
        blocks = -(-max(len(h), self.length) // self.step)
        found = set()
        per = self.length // self.step
        v = np.full(max(blocks, windows + per - 1) * self.step, np.iinfo(np.uint64).max, np.uint64)
        for b in range(self.bands):
            own = v[: len(h)]
            np.multiply(h, self.multiply[b], out=own)
            own += self.add[b]
            low = v.reshape(-1, self.step).min(axis=1) if self.step > 1 else v
            low = functools.reduce(np.minimum, [low[k : k + windows] for k in range(per)])
            for t, s in enumerate(self.signatures[:, b]):
                found.update((w, t) for w in np.nonzero(low == s)[0].tolist())
        return sorted(found)


class Scanner:
    def __init__(self, templates):
        self.hash: dict[bytes, int] = {}
        rng, groups = np.random.default_rng(20240101), {}
        for name, text in templates:
            w = words(text)
            if not w:
                continue
            k = min(SHINGLE, len(w))
            shingles = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            size = 1 << (len(shingles) - 1).bit_length()
            if (k, size) not in groups:
                groups[k, size] = Group(k, size, rng)
            groups[k, size].put(name, shingles, self.shingles(self.hashes(w), k))
        self.groups = list(groups.values())

    def hashes(self, w: list[bytes]) -> np.ndarray:
        known = self.hash
        if len(known) > CACHE:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x)
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))

    @staticmethod
    def shingles(h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        x = np.full(n, np.uint64(k))
        for i in range(k):
            x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B185EBCA87)
        return x

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[dict]]]:
        """Number of words and matches of each whole text, each template once, where it is contained best (the first place of equal ones).

        Texts are taken together until they hold TOGETHER bytes: windows run over all their shingles one after the other,
        and what a window finds is verified inside each text by itself.
        """
        out, at = [], 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < TOGETHER:
                group.append(words(texts[at] or b""))
                size += len(texts[at] or b"")
                at += 1
            out += self._together(group)
        return out

    def _together(self, group: list[list[bytes]]) -> list[tuple[int, list[dict]]]:
        h = self.hashes([x for w in group for x in w])
        n = np.array([len(w) for w in group])
        ends = np.cumsum(n)
        best: list[dict] = [{} for _ in group]
        made = {}
        for g in self.groups:
            k = g.shingle
            if k not in made:
                per = np.maximum(n - k + 1, 0)
                stop = np.cumsum(per)
                inside = np.ones(len(h), bool)
                for i in range(k - 1):
                    cut = ends - 1 - i
                    inside[cut[n > i]] = False
                made[k] = (self.shingles(h, k)[inside[: max(0, len(h) - k + 1)]], stop - per, stop)
            own, start, stop = made[k]
            if not len(own):
                continue
            for window, t in g.candidates(own):
                name, wanted = g.templates[t]
                begin = window * g.step
                end = min(begin + g.length, len(own))
                for d in range(int(np.searchsorted(stop, begin, "right")), len(group)):
                    if start[d] >= end:
                        break
                    w, a, b = group[d], max(begin - int(start[d]), 0), min(end, int(stop[d])) - int(start[d])
                    here = [tuple(w[i : i + k]) for i in range(a, b)]
                    share = len(wanted.intersection(here)) / len(wanted)
                    if share >= CONTAINMENT and share > best[d].get(name, (0.0, 0))[0]:
                        best[d][name] = (share, next(a + i for i, s in enumerate(here) if s in wanted))
        return [(int(c), [{"template": x, "first_word": p, "containment": s} for x, (s, p) in sorted(found.items())]) for c, found in zip(n, best)]


_scanners: dict[tuple, Scanner] = {}


def _scanner(fixed: tuple) -> Scanner:
    """The worker's own, kept between tasks."""
    if fixed not in _scanners:
        _scanners[fixed] = Scanner(fixed)
    return _scanners[fixed]


def license_scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, matches (template, first_word, containment) of each row.

    ``templates``: (name, text) pairs, a list that the caller bounds. Words are runs of ASCII letters, digits and
    non-ASCII bytes, lower-cased; shingles have five words (a template of fewer words is one shingle). A template matches
    where a window of the text holds at least 0.8 of its different shingles. The number of bands of each size class is
    set so that such a window is retrieved with probability RECALL or more; verification compares words.

    Null, empty and wordless texts: no matches. Ties: the first window. Repeated rows get a row each. Other columns are
    ignored; empty input gives no rows; templates without words match nothing.
    """
    fixed = tuple(map(tuple, templates))

    def scan(batches):
        one = _scanner(fixed)
        kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
        for b in batches:
            got = one.scan(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], kind)], names=["doc_id", "n_words", "matches"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {id_type}, n_words long, matches {MATCHES}").withColumnRenamed("doc_id", id_col)
