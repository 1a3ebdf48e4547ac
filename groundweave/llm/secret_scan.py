"""Secrets in texts: keyword automaton, anchored patterns at its hits, checksums.

An Aho-Corasick automaton over the keywords runs once over a text whose ASCII letters are
lowered; each kind's pattern is then tried only at the hits, from left to right, never
inside its previous match, which gives the matches that a search over the whole text
would give. Hexadecimal runs have no keyword of letters: there the text's bytes are
mapped to two classes and the keyword is sixteen of the class "hexadecimal digit".

Kinds ``assign``, ``access`` and ``hex`` are the base; ``github`` and ``npm`` tokens are
added where the checksum inside them (base-62 CRC-32 of the part before) holds.

Spans count code points, end exclusive. Null text counts as empty and has no spans; a
null doc_id stays null; repeated rows give repeated rows; an empty table gives none;
columns other than the two are ignored by ``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, texts_of, trim

# Keywords, and the pattern tried at each one's hits.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED_PATTERN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
KINDS = ("assign", "access", "hex", "github", "npm")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        made.add_word(word, ("assign", len(word)))
    made.add_word("akia", ("access", 4))
    for kind, starts in CHECKED.items():
        for word in starts:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def base62_crc(text: str) -> str:
    """CRC-32 of the text as six base-62 digits."""
    v, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        v, d = divmod(v, 62)
        out = BASE62[d] + out
    return out


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed."""
    if not text:
        return []
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = text.translate(_ASCII_LOWER)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(lowered):
        hits.setdefault(kind, []).append(end - n + 1)
    found = []
    for kind, starts in hits.items():
        last = 0
        for start in sorted(starts):
            if start < last:
                continue
            if kind == "assign":
                m = ASSIGN.match(text, start)
                keep = m and len(m[2]) >= MIN_ASSIGN
            elif kind == "access":
                m = ACCESS.match(text, start)
                keep = m and m.end() - start >= MIN_ACCESS
            else:
                m = CHECKED_PATTERN.match(text, start)
                keep = m and base62_crc(m[1]) == m[2]
            if m:
                last = m.end()
                if keep:
                    found.append((start, last, kind))
    raw = text.encode("utf-8", "surrogatepass")
    classes = raw.translate(_HEX_CLASS)
    at = classes.find(b"h" * MIN_HEX)
    while at >= 0:
        start = at if len(raw) == len(text) else len(raw[:at].decode("utf-8", "surrogatepass"))
        end = HEX.match(text, start).end()
        found.append((start, end, "hex"))
        at = classes.find(b"h" * MIN_HEX, at + end - start)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _slices(batches, rows: int = 500):
    """Batches of a few texts, so that a task never holds many as Python strings."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of every row, also of those without any."""

    def run(batches):
        automaton = _automaton()
        for batch in _slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t, automaton)] for t in texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])
        trim()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every span of a secret replaced by ``mark``; all columns stay, null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = _automaton()
        for batch in _slices(batches):
            texts, changed = batch.column(at).to_pylist(), False
            for i, text in enumerate(texts):
                if spans := find_spans(text, automaton) if text else []:
                    out, last, changed = [], 0, True
                    for start, end, _ in spans:
                        if start >= last:
                            out += [text[last:start], mark]
                        last = max(last, end)
                    texts[i] = "".join([*out, text[last:]])
            columns = [pa.array(texts, batch.schema.field(i).type) if changed and i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        trim()

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the sha256 of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
