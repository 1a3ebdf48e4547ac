"""Vectorised words, word hashes and shingles over Arrow string buffers.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D);
UTF-8 continuation bytes never fall in that set, so byte runs are code-point runs.
All work is numpy over one bounded slice of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single document forms its own slice.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes stay within ``most`` (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of documents [i, j): hashes, byte bounds, and each document's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True, skip: np.ndarray | None = None):
        """``skip``: 256 flags of the bytes that separate words, ASCII white space by default."""
        base = int(offsets[0])
        data = raw[base : int(offsets[-1])]
        off = offsets - base
        inside = ~(_SPACE if skip is None else skip)[data]
        n = len(data)
        fence = np.zeros(n + 1, dtype=bool)
        fence[off] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | fence[1:n]
            ends[:-1] &= ~inside[1:] | fence[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, off)  # of each document, with the total at the end
        self.data, self.doc_bytes = data, off

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k-1 positions are left out."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m].copy()
    for j in range(1, k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[j : j + m]
    return mix(total)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, ascending within it: (hashes, offsets).

    A document with fewer than k words, but some, has its whole sequence as its one shingle;
    a document without words has none.
    """
    count = np.diff(words.first)
    grams = gram_hashes(words.hash, k)
    docs = words.doc_of()
    keep = np.zeros(len(docs), dtype=bool)
    if len(grams):
        keep[: len(grams)] = docs[: len(grams)] == docs[k - 1 :]
    where = np.flatnonzero(keep)
    values, owner = grams[where], docs[where]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([_sequence_hash(words.hash[words.first[d] : words.first[d + 1]]) for d in short], np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    if len(values):
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def _sequence_hash(hashes: np.ndarray) -> int:
    return int(mix(gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))[0])
