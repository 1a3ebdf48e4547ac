"""The ids of whole documents by class runs, vectorised: what ``_bpe`` does unit by unit, without a Python object a word.

It serves documents made of ASCII (but the apostrophe) and two-byte letters that the
tokenizer's normal form leaves letters, with single blanks or line ends between other signs
and no added token's string; the rest go the plainer way of ``_bpe``. There
every run of letters, of digits or of other signs, with the blank before it where blanks
count, is encoded alike wherever it stands. Each distinct run is encoded once while the
cache keeps it: a sorted array of 64-bit hashes, checked by length and outer bytes,
beside a pool of ids, about 40 bytes an entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._words import _power_tables, mix, slices, text_buffer

#: Entries that a worker's cache keeps.
CACHE_RUNS = 1_000_000

_LETTER, _DIGIT, _SIGN, _BLANK, _LINE, _ODD = 1, 2, 3, 0, 4, 5
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0x20], _KIND[0x0A], _KIND[0x27] = _BLANK, _LINE, _ODD
_KIND[0xC3:0xCA] = _LETTER  # leads of U+00C0 to U+027F; which of those count is the encoder's to say
_KIND[0x80:0xC0] = _LETTER  # what follows a lead
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Runs:
    def __init__(self, owner):
        """``owner``: the ``_bpe.Encoder`` that encodes new runs and odd documents."""
        self.owner = owner
        self.odd = np.ones(0x280, dtype=bool)
        self.odd[owner.letters] = False
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> list[bytes]:
        out: list[bytes] = []
        for i, j in slices(offsets, 2 << 20):
            out += self._slice(raw, offsets[i : j + 1], end_id)
        return out

    def _slice(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> list[bytes]:
        base, tail = int(offsets[0]), np.array([end_id], "<u4").tobytes()
        data, off = raw[base : int(offsets[-1])], offsets - base
        n, docs = len(data), len(off) - 1
        out: list[bytes] = [tail] * docs
        if not n:
            return out
        kind = _KIND[data]
        white = (kind == _BLANK) | (kind == _LINE)
        bad = kind == _ODD
        bad[1:] |= white[1:] & white[:-1]
        # A lone follower belongs to U+0080 to U+00BF, whose lead is odd.
        lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
        bad[lead] |= self.odd[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
        if self.owner.any_added.pattern:
            text = data.tobytes()
            for token in map(str.encode, self.owner.added):
                at = text.find(token)
                while at >= 0:
                    bad[at] = True
                    at = text.find(token, at + 1)
        else:
            bad[:] = True
        ends = off[1:][off[1:] > off[:-1]] - 1
        begins = off[:-1][off[1:] > off[:-1]]
        bad[begins] |= white[begins]
        bad[ends] |= white[ends]
        worst = np.concatenate([[0], np.cumsum(bad)])
        odd = worst[off[1:]] > worst[off[:-1]]
        if odd.any():
            which = np.flatnonzero(odd)
            texts = [data[off[d] : off[d + 1]].tobytes().decode("utf-8", "surrogatepass") for d in which.tolist()]
            for d, ids in zip(which.tolist(), self.owner.encode(texts, end_id), strict=True):
                out[d] = ids
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[off] = True
        bounds = np.flatnonzero(edge)
        sort = kind[bounds[:-1]]
        doc = np.searchsorted(off, bounds[:-1], side="right") - 1
        keep = (sort != _BLANK) & ~odd[doc]
        if not self.owner.spaced:
            keep &= sort != _LINE
        start, end, sort, doc = bounds[:-1][keep], bounds[1:][keep], sort[keep], doc[keep]
        if not len(start):
            return out
        if self.owner.spaced:
            before = np.maximum(start - 1, 0)
            blank = (start > off[doc]) & (kind[before] == _BLANK) & (sort != _LINE)
            start = start - blank
        sums = np.zeros(n + 1, np.uint64)
        up, down = _power_tables(n + 1)
        np.cumsum((data if self.owner.spaced else _LOWER[data]).astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
        keys = mix((sums[end] - sums[start]) * down[start])
        del sums
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        a, b = start[first], end[first]
        front, back = data[a], data[b - 1]
        if not self.owner.spaced:
            front, back = _LOWER[front], _LOWER[back]
        checks = ((b - a).astype(np.uint32) << np.uint32(16)) | (front.astype(np.uint32) << np.uint32(8)) | back
        where = self._find(distinct)
        if len(new := np.flatnonzero(where < 0)):
            if len(self.keys) + len(new) > CACHE_RUNS:
                self._keep_only(where[where >= 0])
                where = self._find(distinct)
            self._add(distinct[new], checks[new], data, a[new], b[new], sort[first[new]])
            where = self._find(distinct)
        if (self.checks[where] != checks).any():  # two runs with one hash: nothing may be mixed up
            self.clear()
            plain = np.unique(doc).tolist()
            texts = [data[off[d] : off[d + 1]].tobytes().decode("utf-8", "surrogatepass") for d in plain]
            for d, ids in zip(plain, self.owner.encode(texts, end_id), strict=True):
                out[d] = ids
            return out
        size, at = self.sizes[where][inverse], self.at[where][inverse]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        index = np.repeat(at - total[:-1], size)
        index += np.arange(total[-1])
        ids = self.pool[index].tobytes()
        cuts = (total[np.searchsorted(doc, np.arange(docs + 1))] * 4).tolist()
        for d in np.flatnonzero(~odd).tolist():
            out[d] = ids[cuts[d] : cuts[d + 1]] + tail
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        return np.where(self.keys[where] == keys, where, -1)

    def _keep_only(self, where: np.ndarray) -> None:
        """Forgets all entries but these, which the present slice uses."""
        where = np.sort(where)
        sizes = self.sizes[where]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.pool = self.pool[np.repeat(self.at[where] - total[:-1], sizes) + np.arange(total[-1])]
        self.keys, self.checks, self.sizes, self.at = self.keys[where], self.checks[where], sizes, total[:-1]

    def _add(self, keys, checks, data, a, b, sort) -> None:
        sizes = np.zeros(len(keys), np.int64)
        pieces: list[np.ndarray] = []
        order: list[np.ndarray] = []
        plain = sort == _LETTER
        if self.owner.spaced:
            plain &= data[a] == 0x20
        todo = np.flatnonzero(plain)
        for g in range(0, len(todo), 40_000):
            got = self._joined(data, a, b, todo[g : g + 40_000])
            for members, ids, counts in got:
                sizes[members] = counts
                pieces.append(ids)
                order.append(members)
        rest = np.flatnonzero(~plain)
        for g in range(0, len(rest), 20_000):
            members = rest[g : g + 20_000]
            texts = [data[p:q].tobytes().decode("utf-8", "surrogatepass") for p, q in zip(a[members].tolist(), b[members].tolist(), strict=True)]
            found = self.owner._whole(texts)
            sizes[members] = [len(x) // 4 for x in found]
            pieces.append(np.frombuffer(b"".join(found), "<u4"))
            order.append(members)
        order_all = np.concatenate(order)
        at = np.zeros(len(keys), np.int64)
        ends = np.cumsum(sizes[order_all])
        at[order_all] = len(self.pool) + ends - sizes[order_all]
        self.pool = np.concatenate([self.pool, *pieces])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.checks = np.insert(self.checks, where, checks)
        self.at = np.insert(self.at, where, at)
        self.sizes = np.insert(self.sizes, where, sizes)

    def _joined(self, data, a, b, members):
        """Ids of runs of letters, some hundred a call, told apart by the ids that open or close a word."""
        spaced = self.owner.spaced
        width = (b - a)[members] + (not spaced)
        total = np.concatenate([[0], np.cumsum(width)])
        index = np.repeat(a[members] - total[:-1], width) + np.arange(total[-1])
        letters = data[np.minimum(index, len(data) - 1)]
        if not spaced:
            letters[total[1:] - 1] = 0x20
        raw = letters.tobytes()
        groups = [members[g : g + 400] for g in range(0, len(members), 400)]
        cuts = [int(total[min(g + 400, len(members))]) for g in range(0, len(members), 400)]
        texts = [raw[p:q].decode("utf-8", "surrogatepass") for p, q in zip([0, *cuts[:-1]], cuts, strict=True)]
        for group, e in zip(groups, self.owner.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            starts = np.flatnonzero(self.owner.opens[ids]) if spaced else np.concatenate([[0], np.flatnonzero(self.owner.closes[ids])[:-1] + 1])
            if len(starts) != len(group):
                found = self.owner._whole([data[a[m] : b[m]].tobytes().decode("utf-8", "surrogatepass") for m in group.tolist()])
                yield group, np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
            else:
                yield group, ids, np.diff(np.append(starts, len(ids)))


def encode_array(owner, texts: pa.Array, end_id: int) -> list[bytes]:
    """Each text's ids and the end id, as little-endian uint32; a null counts as empty."""
    if not hasattr(owner, "runs"):
        owner.runs = Runs(owner)
    raw, offsets = text_buffer(texts)
    return owner.runs.encode(raw, offsets, end_id)
