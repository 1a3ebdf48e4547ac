"""Document quality: hashed word n-gram logistic regression, trained by FTRL-proximal.

Tokens are runs of letters (ASCII letters lowered), digits or other signs, and line ends.
Features are hashed unigrams and bigrams of tokens, and trigrams of token shapes (the
case of a word, the signs themselves); a feature's value is its share of the document's
n-grams of that sort times ``SCALE``. A score is the logistic function of the bias plus
the sparse dot product of values and weights.

Training takes at most ``train_rows`` labelled ids, those of least hash, with one text and
one label each (of several texts that of least hash, of both labels 0), and goes over them
``epochs`` times in a fixed order, in one task; the driver gets the weights alone. Scoring is a map over whole texts with a table of 2^``BITS`` weights.

Null or empty texts have no features and get the bias' score; a null doc_id stays null;
repeated rows get equal scores and are learned from once; rows with a null label aren't learned from; with no
labelled rows every score is 0.5. Columns other than those named are ignored by
``score_quality`` and kept by ``keep_quality``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, texts_of, trim
from ._words import gram_hashes, mix, slices, text_buffer, _power_tables

BITS = 18
SCALE = 16.0
THRESHOLD = 0.3

_LETTER, _DIGIT, _SIGN, _LINE = 1, 2, 3, 4
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x0A] = _LINE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of every n-gram occurrence in the documents of a slice."""
    base = int(offsets[0])
    data, off = raw[base : int(offsets[-1])], offsets - base
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    kind = _CLASS[data]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[off] = True
    bounds = np.flatnonzero(edge)
    inside = kind[bounds[:-1]] > 0
    start, end = bounds[:-1][inside], bounds[1:][inside]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sort = kind[start]
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
    token = mix((sums[end] - sums[start]) * down[start])
    caps = np.zeros(n + 1, np.int32)
    np.cumsum(_UPPER[data], out=caps[1:])
    upper = caps[end] - caps[start]
    case = np.where(upper == 0, 1, np.where((upper == 1) & _UPPER[data[start]], 2, np.where(2 * upper >= end - start, 3, 4)))
    shape = np.where(sort == _LETTER, mix(case.astype(np.uint64)), np.where(sort == _DIGIT, np.uint64(77), token))
    doc = np.searchsorted(off, start, side="right") - 1
    out_doc, out_feature, out_value = [], [], []
    for salt, source, k in ((1, token, 1), (2, token, 2), (3, shape, 3)):
        grams = mix(gram_hashes(source, k) + np.uint64(salt))
        if not len(grams):
            continue
        at = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :])
        owner = doc[at]
        share = SCALE / np.bincount(owner, minlength=len(off) - 1)[owner]
        out_doc.append(owner)
        out_feature.append((grams[at] >> np.uint64(64 - BITS)).astype(np.int64))
        out_value.append(share.astype(np.float32))
    return np.concatenate(out_doc), np.concatenate(out_feature), np.concatenate(out_value)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Weights (the bias last) from rows of (features, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            index, value, label = rows[i]
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def held_out(id_col):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(id_col.cast("string")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, *, train_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from at most ``train_rows`` labelled rows that aren't held out."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(texts_of(batch))
            labels_of, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            rows = []
            for i, j in slices(offsets):
                doc, feature, value = features(raw, offsets[i : j + 1])
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(j - i + 1))
                for d in range(j - i):
                    at = order[cuts[d] : cuts[d + 1]]
                    index, where = np.unique(feature[at], return_inverse=True)
                    summed = np.bincount(where, value[at], len(index)).astype("<f4")
                    rows.append((ids[i + d], labels_of[i + d], index.astype("<u4").tobytes(), summed.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["doc_id", "label", "features", "values"])

    # The chosen ids are at most train_rows: a bounded table, read once for their texts.
    picked = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.min("label").alias("label"))
    made = picked.mapInArrow(run, "doc_id long, label int, features binary, values binary")

    def learn(batches):
        got = sorted(zip(*(sum((b.column(c).to_pylist() for b in held), []) for c in range(4)), strict=True)) if (held := list(batches)) else []
        rows = []
        for _, label, index, value in got:
            index = np.append(np.frombuffer(index, "<u4").astype(np.int64), 1 << BITS)
            rows.append((index, np.append(np.frombuffer(value, "<f4"), np.float32(1)).astype(np.float64), label))
        yield pa.RecordBatch.from_arrays([pa.array([train_ftrl(rows).tobytes()], pa.binary())], ["weights"])
        trim()

    return np.frombuffer(made.repartition(1).mapInArrow(learn, "weights binary").first().weights, np.float32)


def _scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    raw, offsets = text_buffer(texts)
    out = np.zeros(len(offsets) - 1)
    for i, j in slices(offsets):
        doc, feature, value = features(raw, offsets[i : j + 1])
        out[i:j] = np.bincount(doc, weights[feature].astype(np.float64) * value, j - i)
    return 1 / (1 + np.exp(-np.clip(out + float(weights[-1]), -35, 35)))


def score_quality(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(texts_of(batch), shared.value))], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at)
                yield batch.filter(pa.array(_scores(texts.fill_null("") if texts.null_count else texts, shared.value) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
