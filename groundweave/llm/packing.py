"""Packing token ids into fixed windows by sum-of-squares online placement.

Each task packs the documents it reads, in their order. A document's whole windows are
sequences by themselves; the rest of it is one item of size r < window. A level array
N[h] counts the open windows filled to h. The item goes where the sum over 0 < h < window
of N[h]^2 grows least: into a window at some level h with h + r <= window, or into a new
one. Ties go to the fullest window. When ``max_open`` windows are open, and at the task's
end, the emptiest windows are cut up to fill the others, so that at most one partly filled
window a task is left; documents may be cut anywhere.

Memory: ``max_open`` windows and the ids of the longest document. Nothing is shuffled and
no task needs another, so a lost executor costs its tasks alone.

Null text counts as empty (its end id alone); a null doc_id stays null; repeated rows are
documents of their own; an empty table gives no pieces; columns other than the two are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe
from ._common import id_and_text, texts_of, trim
from ._units import encode_array

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_FLUSH_BYTES = 4 << 20


class SumOfSquares:
    """Windows of one task. Pieces are [doc_id, start, ids (bytes), doc_tokens]; closed windows go to ``emit``."""

    def __init__(self, window: int, max_open: int, emit):
        self.window, self.max_open, self.emit = window, max_open, emit
        self.count = np.zeros(window + 1, np.int64)  # N; both ends stay 0
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, r: int) -> int:
        """The level of the window to place r ids in; 0: a new one."""
        reach = self.window - r
        before = self.count[1 : reach + 1]
        used = np.flatnonzero(before)
        best, level = 2 * self.count[r] + 1, 0
        if len(used):
            levels = used + 1
            after = self.count[levels + r]  # 0 where the window becomes full
            change = 2 * (after - before[used]) + 1 + (levels != reach)
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(levels[at])
        return level

    def place(self, doc_id, ids: bytes) -> None:
        n, width = len(ids) // 4, self.window * 4
        full = n // self.window
        for k in range(full):
            self.emit([[doc_id, k * self.window, ids[k * width : (k + 1) * width], n]])
        r = n - full * self.window
        if not r:
            return
        piece = [doc_id, full * self.window, ids[full * width :], n]
        h = self.level_for(r)
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        self._put(h + r, pieces)
        if self.n_open >= self.max_open:
            self.drain()

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self.emit(pieces)
        elif pieces:
            self.open.setdefault(level, []).append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def drain(self) -> None:
        """Fills the fuller windows with what the emptiest hold, cut as needed."""
        left = [[level, pieces] for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        low, high = 0, len(left) - 1
        while low < high:
            gap = self.window - left[high][0]
            if not gap:
                self.emit(left[high][1])
                high -= 1
                continue
            pieces = left[low][1]
            doc_id, start, ids, n = pieces.pop()
            size = len(ids) // 4
            moved = min(gap, size)
            if moved < size:
                pieces.append([doc_id, start, ids[: (size - moved) * 4], n])
            left[high][1].append([doc_id, start + size - moved, ids[(size - moved) * 4 :], n])
            left[high][0] += moved
            left[low][0] -= moved
            low += not left[low][0]
        if low == high:
            self._put(*left[low])

    def close(self) -> None:
        self.drain()
        for windows in self.open.values():
            for pieces in windows:
                self.emit(pieces)


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids (little-endian uint32): see the module's text.

    ``sequence_id`` holds the task in its upper and the task's running number in its lower
    33 bits; ``offset`` is the piece's place in its sequence, gapless from 0.
    """

    def pack(batches):
        task = TaskContext.get().partitionId()
        encoder = _bpe.encoder(tokenizer)
        rows: list[tuple] = []
        state = {"sequence": task << 33, "bytes": 0}

        def emit(pieces):
            offset = 0
            for doc_id, start, ids, n in pieces:
                rows.append((doc_id, start, len(ids) // 4, n, state["sequence"], offset, ids))
                offset += len(ids) // 4
            state["bytes"] += offset * 4
            state["sequence"] += 1

        def taken():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            state["bytes"] = 0
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        packer = SumOfSquares(window, max_open, emit)
        for batch in batches:
            for part in _rounds(batch):
                ids_of = encode_array(encoder, texts_of(part), end_id)
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                    packer.place(doc_id, ids)
                    if state["bytes"] >= _FLUSH_BYTES:
                        yield taken()
        packer.close()
        if rows:
            yield taken()
        trim()

    return id_and_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)


def _rounds(batch: pa.RecordBatch, most: int = 8 << 20):
    """The batch in parts of about ``most`` bytes of text."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
