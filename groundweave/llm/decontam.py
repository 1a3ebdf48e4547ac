"""Documents that contain benchmark items: greedy string tiling over words.

Words are runs of Unicode letters and digits of the text in NFC, case folded, so that signs,
case and decomposed accents don't hide a passage. Seeds are word ``seed``-grams that a document shares with an item: the
items' grams are a sorted table, the documents' gram hashes are looked up in it. For each
document and item with a seed, tiling runs: of all matches between words not yet marked,
the longest is marked first, then the next, down to ``least`` words; matches are found by
Karp-Rabin hashes of ``least`` words and stretched. An item's coverage is the share of its
words under tiles; as tiles need not lie in order, reordered passages count. An item
shorter than ``least`` words is matched whole.

A document is contaminated by an item when coverage reaches ``threshold``.

The table of items is broadcast when their text is at most ``broadcast_bytes`` (checked);
beyond it the items are tiled in parts of that size, one pass over the documents each.

Null text holds nothing; a null doc_id or item_id is carried along; repeated rows and
items give repeated results; empty tables give none; columns other than those named are
ignored by ``contaminated`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text
from ._words import Words, gram_hashes, slices, text_buffer

SEED, LEAST, THRESHOLD = 5, 5, 0.5

_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@cache
def _apart() -> np.ndarray:
    """Flag of every code point that separates words."""
    return np.array([not chr(i).isalnum() for i in range(sys.maxunicode + 1)])


def _folded(text: str) -> str:
    """NFC and case folded, what isn't a letter or digit as a blank."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(_apart()[points], np.uint32(32), points).astype("<u4").tobytes().decode("utf-32-le")


def words_of(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first document, words) of each slice of texts; ASCII texts are split and lowered as bytes."""
    raw, offsets = text_buffer(texts)
    for i, j in slices(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        high = np.concatenate([[0], np.cumsum(part >= 128)])
        if high[-1]:
            plain = (high[off[1:]] == high[off[:-1]]).tolist()
            data = part.tobytes()
            bounds = zip(off[:-1].tolist(), off[1:].tolist(), plain, strict=True)
            made = [data[a:b] if ascii_only else _folded(data[a:b].decode()).encode() for a, b, ascii_only in bounds]
            part = np.frombuffer(b"".join(made), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(m) for m in made], dtype=np.int64)])
        yield i, Words(part, off, skip=_APART)


class Items:
    """The items' words and the sorted table of their grams."""

    def __init__(self, ids: list, texts: list[str | None], seed: int, least: int):
        self.ids, self.seed, self.least = ids, seed, least
        self.words = [w.hash[w.first[d] : w.first[d + 1]] for _, w in words_of(pa.array(texts, pa.large_string())) for d in range(len(w.first) - 1)]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grams: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                k = min(seed, len(w))
                grams.setdefault(k, []).append((np.unique(gram_hashes(w, k)), i))
        for k, parts in grams.items():
            values = np.concatenate([p[0] for p in parts])
            owners = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
            order = np.argsort(values, kind="stable")
            self.by_size[k] = values[order], owners[order]
        # A bit table drops nearly all document grams before the sorted table is searched.
        self.bits = {k: _bits(values) for k, (values, _) in self.by_size.items()}

    def seeded(self, words: Words) -> list[tuple[int, int]]:
        """(document, item) pairs that share a seed."""
        pairs = []
        docs = words.doc_of()
        for k, (values, owners) in self.by_size.items():
            grams = gram_hashes(words.hash, k)
            maybe = np.flatnonzero(self.bits[k][grams >> np.uint64(44)])
            if not len(maybe):
                continue
            g = grams[maybe]
            lo, hi = np.searchsorted(values, g, "left"), np.searchsorted(values, g, "right")
            hit = (hi > lo) & (docs[maybe] == docs[maybe + k - 1])
            maybe, lo, hi = maybe[hit], lo[hit], hi[hit]
            if len(maybe):
                count = hi - lo
                index = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                pairs.append(np.stack([np.repeat(docs[maybe], count), owners[index]], axis=1))
        if not pairs:
            return []
        return [tuple(p) for p in np.unique(np.concatenate(pairs), axis=0).tolist()]


def _bits(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, dtype=bool)
    table[values >> np.uint64(44)] = True
    return table


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length): longest unmarked matches first, ties to the leftmost in pattern and then text."""
    least = max(1, min(least, len(pattern)))
    used_p, used_t = np.zeros(len(pattern), dtype=bool), np.zeros(len(text), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    grams_p, grams_t = gram_hashes(pattern, least), gram_hashes(text, least)
    if not len(grams_p) or not len(grams_t):
        return tiles
    # Positions of the text whose hash occurs in the pattern: all matches start and stay there.
    order = np.argsort(grams_p, kind="stable")
    ranked = grams_p[order]
    lo, hi = np.searchsorted(ranked, grams_t, "left"), np.searchsorted(ranked, grams_t, "right")
    at = np.flatnonzero(hi > lo)
    count = (hi - lo)[at]
    t = np.repeat(at, count)
    p = order[np.repeat(lo[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    if not len(t):
        return tiles
    # Neighbouring hits on one diagonal are one match: runs of hits.
    by = np.lexsort((t, t - p))
    p, t = p[by], t[by]
    fresh = np.ones(len(t), dtype=bool)
    fresh[1:] = (t[1:] - p[1:] != t[:-1] - p[:-1]) | (t[1:] != t[:-1] + 1)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(t))) + least - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, p[first], t[first], strict=True)]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = used_p[a : a + n] | used_t[b : b + n]
        if not taken.any():
            used_p[a : a + n] = used_t[b : b + n] = True
            tiles.append((a, b, n))
            continue
        # What is left of it between marks comes again with its own length.
        free = np.flatnonzero(np.diff(np.concatenate([[0], ~taken, [0]]).astype(np.int8)))
        for x, y in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return tiles


def _found(texts: pa.Array, items: Items, threshold: float) -> list[tuple[int, int, int, int, float, list]]:
    """(document, item, words under tiles, tiles, coverage, tiles' places) of contaminated documents."""
    rows = []
    for i, words in words_of(texts):
        for d, item in items.seeded(words):
            pattern, text = items.words[item], words.hash[words.first[d] : words.first[d + 1]]
            tiles = tile(pattern, text, items.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(pattern):
                rows.append((i + d, item, covered, len(tiles), covered / len(pattern), tiles))
    return rows


def _item_parts(benchmark: DataFrame, item_col: str, text_col: str, broadcast_bytes: int) -> list[list]:
    """The items in parts of at most ``broadcast_bytes`` of text (one item at least)."""
    rows = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    parts: list[list] = []
    size = broadcast_bytes
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if size + len(r.text) > broadcast_bytes:
            parts.append([])
            size = 0
        parts[-1].append((r.item_id, r.text))
        size += len(r.text)
    return parts


def contaminated(docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED, least: int = LEAST, threshold: float = THRESHOLD, broadcast_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item of it: doc_id, item_id, n_words (under tiles), n_tiles, coverage and the tiles."""
    schema = "doc_id long, item_id long, n_words long, n_tiles long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    source, out = id_and_text(docs, id_col, text_col), None
    for part in _item_parts(benchmark, item_col, item_text_col, broadcast_bytes) or [[]]:
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            items = Items([i for i, _ in shared.value], [t for _, t in shared.value], seed, least)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], items.ids[i], n, k, c, [dict(zip(("item_start", "doc_start", "length"), x, strict=True)) for x in sorted(tiles)]) for d, i, n, k, c, tiles in _found(batch.column(1), items, threshold)]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), tile_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_words", "n_tiles", "coverage", "tiles"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, seed: int = SEED, least: int = LEAST, threshold: float = THRESHOLD, broadcast_bytes: int = 32 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that no item contaminates, with all their columns; a map without a shuffle."""
    at = docs.columns.index(text_col)
    for part in _item_parts(benchmark, item_col, item_text_col, broadcast_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            items = Items([i for i, _ in shared.value], [t for _, t in shared.value], seed, least)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, *_ in _found(batch.column(at), items, threshold)]] = False
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
