"""Whole-text encoding with a public tokenizer file, one cached unit (word) at a time.

A text is cut before blanks and line ends. No pre-token of the two supported kinds of
tokenizer crosses such a place, so the ids of the units, joined, are the ids of the text.
A text in which white space stands before a blank or line end is encoded whole where runs
of white space matter (byte-level), since there a cut could split a run; so is a text that
holds the string of an added token, which the tokenizer takes as that token.

A unit of letters and then punctuation is in turn two pre-tokens: its letters are encoded
with many others in one call and told apart by the ids that open or close a word.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task a core

#: Entries that each of a worker's two caches keeps; about 250 bytes each.
CACHE_UNITS = 200_000
#: Characters of text handled in one round.
ROUND_CHARS = 8 << 20

_RUN = re.compile(r"[\s\x1c-\x1f][ \n]")
#: Two-byte code points that may count as letters: up to Latin Extended-B, whose classes are the same in every version of Unicode.
LATIN = range(0xC0, 0x250)
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Cache:
    """Values by key: those asked for in two rounds running stay, up to a bound."""

    def __init__(self):
        self.kept: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}

    def round(self, keys: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """The values of all keys of this round; what isn't known is made."""
        new = keys - self.kept.keys()
        known = new & self.young.keys()
        if len(self.kept) < CACHE_UNITS:
            self.kept.update((k, self.young[k]) for k in known)
            new -= known
            known = set()
        todo = list(new - known)
        fresh = dict(zip(todo, make(todo), strict=True))
        fresh.update((k, self.young[k]) for k in known)
        self.young = fresh
        return fresh


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        normal = self.tokenizer.normalizer
        self.spaced = normal is None  # ids depend on the white space before a word
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.any_added = re.compile("|".join(map(re.escape, self.added)) or "(?!)")
        if any(t.normalized or t.lstrip or t.rstrip for t in added):
            self.any_added = re.compile("")  # found in other forms than their own: every text is encoded whole
        #: Letters that stay nothing but letters in the tokenizer's normal form.
        self.letters = [c for c in LATIN if all(unicodedata.category(x)[0] == "L" for x in (chr(c) if normal is None else normal.normalize_str(chr(c))))]
        self.plain = re.compile(f"([A-Za-z{''.join(map(chr, self.letters))}]+)([!-&(-/:-@\\[-`{{-~]*)")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
            self.closes[i] = token.endswith("</w>")
        self.units, self.words = _Cache(), _Cache()
        self.line_end = self._whole(["\n"])[0] if self.spaced else b""

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Each text's ids and the end id, as little-endian uint32."""
        out: list[bytes] = []
        a = size = 0
        for b, text in enumerate(texts):
            size += len(text)
            if size >= ROUND_CHARS:
                out += self._round(texts[a : b + 1], end_id)
                a, size = b + 1, 0
        return out + self._round(texts[a:], end_id)

    def _round(self, texts: list[str], end_id: int) -> list[bytes]:
        tail = np.array([end_id], dtype="<u4").tobytes()
        out: list[bytes] = [tail] * len(texts)
        split: list[list[str]] = []
        at: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.any_added.search(text):
                whole.append(i)
            elif not self.spaced:
                split.append(text.replace("\n", " ").split(" "))
                at.append(i)
            elif _RUN.search(text):
                whole.append(i)
            else:
                # A unit has lost the blank before it and keeps a line end; \0 marks the first.
                split.append(("\0" + text).replace("\n", " \n").split(" "))
                at.append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids + tail
        if split:
            fresh = self.units.round(set().union(*split), self._encode_units)
            kept = self.units.kept
            get = {**kept, **fresh}.__getitem__ if len(kept) < len(fresh) else None
            for i, units in zip(at, split, strict=True):
                if get is None:
                    out[i] = b"".join([kept[u] if u in kept else fresh[u] for u in units]) + tail
                else:
                    out[i] = b"".join(map(get, units)) + tail
        return out

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units: letters and punctuation apart where that is exact, else as they are."""
        out: list[bytes | None] = [None] * len(units)
        parts: list[tuple[int, str, str, bytes]] = []
        odd: list[int] = []
        for i, unit in enumerate(units):
            mark = unit[:1] if self.spaced else ""
            head = b""
            if mark == "\n":
                head, body, before = self.line_end, unit[1:], ""
            elif mark == "\0":
                body, before = unit[1:], ""
            else:
                body, before = unit, " " if self.spaced else ""
            found = self.plain.fullmatch(body)
            if found:
                parts.append((i, before + found[1], found[2], head))
            elif mark in ("\n", "\0") and not body:
                out[i] = head
            else:
                odd.append(i)
        for a in range(0, len(odd), 20_000):
            some = odd[a : a + 20_000]
            for i, ids in zip(some, self._whole([self._text(units[i]) for i in some]), strict=True):
                out[i] = ids
        tails = list({p[2] for p in parts})
        tail = dict(zip(tails, self._whole(tails), strict=True)) if tails else {}
        words = {p[1] for p in parts}
        fresh, kept = self.words.round(words, self._encode_words), self.words.kept
        for i, word, end, head in parts:
            out[i] = head + (kept[word] if word in kept else fresh[word]) + tail[end]
        return out

    def _text(self, unit: str) -> str:
        if not self.spaced or unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == "\0" else " " + unit

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, several hundred a call."""
        out: dict[str, bytes] = {}
        if self.spaced:
            bare = [w for w in words if w[0] != " "]
            out.update(zip(bare, self._whole(bare) if bare else [], strict=True))
            words_joined, glue = [w for w in words if w[0] == " "], ""
        else:
            words_joined, glue = words, " "
        groups = [words_joined[a : a + 500] for a in range(0, len(words_joined), 500)]
        for a in range(0, len(groups), 50):
            some = groups[a : a + 50]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([glue.join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                starts = np.flatnonzero(self.opens[ids]) if self.spaced else np.concatenate([[0], np.flatnonzero(self.closes[ids])[:-1] + 1])
                if len(starts) != len(group):
                    out.update(zip(group, self._whole(group), strict=True))
                    continue
                raw, cuts = ids.tobytes(), (np.append(starts, len(ids)) * 4).tolist()
                out.update((w, raw[p:q]) for w, p, q in zip(group, cuts[:-1], cuts[1:], strict=True))
        return [out[w] for w in words]
