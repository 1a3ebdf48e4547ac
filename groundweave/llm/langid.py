"""Language by cross-parsing: the language whose text needs fewest phrases to spell a document wins.

For each language a suffix automaton of a bounded sample of its labelled text is built.
A document is parsed greedily: the longest stretch that occurs in the sample is a phrase,
and the next one starts where it ends. A phrase is spelled by its place in the sample and
its length, log2(symbols of the sample) + log2(``STRETCH``) bits; fewer bits mean lower
cross-entropy with that language, so samples of any size compare: a short one has cheaper
places, but its phrases are shorter still, except in what it really holds. Letters are lowered; the sample's most frequent letters
have symbols of their own, other letters share one, and any run of other signs is one blank.

Automata are dense tables of ``SYMBOLS`` columns: a transition that is missing holds the
state of a new phrase, complemented. Documents are cut into stretches of ``STRETCH``
symbols and all stretches of a batch advance together, a symbol a step; a cut ends a
phrase in every language alike.

Learned from: whole texts of each language (those of least hash), ``docs_per_lang`` or about
``chars_per_lang`` characters at most; only where a language has too few others, texts over
``chars_per_doc`` characters, by ``PIECES`` pieces from head to end. Each language has its
own sample; none is cut for another's. Predictions read whole texts.

Null text, and text without a letter, gives ``und`` with score 0; ties go to the language
that sorts first; a null doc_id stays null; repeated rows get equal results; with nothing
to learn from every row is ``und``. Columns other than those named are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import texts_of
from .quality import held_out

SYMBOLS, STRETCH, PIECES = 64, 256, 4
_BLANK, _OTHER, _FIRST, _PAD = 0, 1, 2, 63


def symbol_table(samples: list[str]) -> np.ndarray:
    """Symbol of every code point."""
    counts = Counter(c for s in samples for c in s.lower() if c.isalpha())
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    table[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = _OTHER
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: _PAD - _FIRST]):
        table[ord(c)] = _FIRST + k
    return table


def symbols_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, each text's offsets, each text's letters), with runs of blanks as one."""
    lowered = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    raw = table[points]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != _BLANK) | (raw[:-1] != _BLANK)
    keep[offsets[:-1][offsets[:-1] < len(raw)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(raw != _BLANK)])
    return raw[keep], kept[offsets], np.diff(letters[offsets])


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Dense transitions of the suffix automaton of a text, as int32 offsets into the table."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        current = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = current
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[current] = copy
        last = current
    # The last row stands before any phrase: every symbol begins one there.
    none = len(following)
    table = np.full((none + 1, SYMBOLS), -1, np.int64)
    for state, moves in enumerate(following):
        for c, target in moves.items():
            table[state, c] = target
    begin = np.where(table[0] >= 0, table[0], none) * SYMBOLS  # a sign the sample lacks is a phrase of its own
    out = np.where(table >= 0, table * SYMBOLS, ~begin[None, :])
    out[:, _PAD] = 0
    return out.astype(np.int32).ravel()


def phrase_counts(symbols: np.ndarray, offsets: np.ndarray, automata: list[np.ndarray]) -> np.ndarray:
    """Phrases of each document under each automaton."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    out = np.zeros((len(sizes), len(automata)))
    first = np.cumsum(pieces) - pieces
    for a in range(0, len(owner), 8192):
        own = owner[a : a + 8192]
        begin = offsets[own] + (np.arange(a, a + len(own)) - first[own]) * STRETCH
        end = np.minimum(begin + STRETCH, offsets[own + 1])
        where = begin[:, None] + np.arange(STRETCH)
        steps = np.where(where < end[:, None], symbols[np.minimum(where, len(symbols) - 1)], _PAD).T.astype(np.int32)
        steps = np.ascontiguousarray(steps)
        for k, table in enumerate(automata):
            state, missed = np.full(len(own), len(table) - SYMBOLS, np.int32), np.zeros(len(own), np.int32)
            for step in steps:
                state += step
                state = table.take(state)
                lost = state >> 31
                missed -= lost
                state ^= lost
            out[:, k] += np.bincount(own, missed, len(sizes))
    return out


def _pieces(text, most: int):
    """A text, or of a longer one ``most`` characters in pieces spread evenly over it."""
    size = max(1, most // PIECES)
    at = lambda i: F.floor((F.length(text) - size) * i / (PIECES - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *(F.substring(text, at(i), F.lit(size)) for i in range(PIECES))))


def train_langid(docs: DataFrame, *, docs_per_lang: int = 40, chars_per_lang: int = 48_000, chars_per_doc: int = 12_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray]:
    """(languages, automata, symbol table, bits of a phrase) learned from labelled rows that aren't held out.

    A language's sample is of whole texts, by the hash of their ids, until they hold
    ``chars_per_lang`` characters or are ``docs_per_lang``. Texts over ``chars_per_doc`` come
    last, where a language has too few others, and as pieces from all of the text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    usable = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", "lang", (F.length("text") > chars_per_doc).alias("long"), _pieces(F.col("text"), chars_per_doc).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text"))
    # At most docs_per_lang rows of bounded size of each language reach the driver.
    got = usable.withColumn("k", rank).where(F.col("k") <= docs_per_lang).orderBy("lang", "k").select("lang", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in got:
        own = samples.setdefault(r.lang, [])
        if sum(map(len, own)) < chars_per_lang:
            own.append(r.text)
    languages = sorted(samples)
    table = symbol_table([t for texts in samples.values() for t in texts])
    automata, bits = [], []
    for lang in languages:
        symbols, _, _ = symbols_of(samples[lang], table)
        automata.append(suffix_automaton(symbols))
        bits.append(np.log2(len(symbols)) + np.log2(STRETCH))
    return languages, automata, table, np.array(bits)


def predict_lang(docs: DataFrame, model: tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's share of likelihood, from 0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training parameters

    def run(batches):
        languages, automata, table, bits = shared.value
        for batch in batches:
            texts = texts_of(batch).to_pylist()
            names, scores = [], []
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and size < 2 << 20:
                    size += len(texts[to])
                    to += 1
                symbols, offsets, letters = symbols_of(texts[at:to], table)
                if languages:
                    counts = phrase_counts(symbols, offsets, automata) * (bits / bits.max())  # in phrases of the largest sample
                    best = counts.argmin(axis=1)
                    odds = np.exp(-np.clip(counts - counts.min(axis=1, keepdims=True), 0, 700))
                    share = 1 / odds.sum(axis=1)
                for i, n in enumerate(letters.tolist()):
                    known = n > 0 and bool(languages)
                    names.append(languages[best[i]] if known else "und")
                    scores.append(float(share[i]) if known else 0.0)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
