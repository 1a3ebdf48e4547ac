"""A content-addressed store of token ids.

``write_store`` encodes documents, cuts each id stream where a rolling hash over the last
ids says so, and stores every distinct chunk once under its digest. A recipe a document
lists its chunks; recipes lie in ascending doc_id order with the running count of ids.
Merkle roots join chunks to documents, documents to ranges, and ranges to the manifest.

    store/kind=chunk    digest, data, n, width    (ids as little-endian uint16 or uint32)
    store/kind=recipe   as the encoding tasks made them, in no order
    recipes             part, row, doc_id, start (within the part), n_tokens, digests, sizes, root
    manifest            part, base, n_docs, n_ids, root

``read_digests`` reads chunks, recipes and manifest back, checks every digest, size and
root, and derives each document's crc32 from those of its chunks (crc32 of a joined
stream is a linear function of its parts'), so that only 30 bytes a chunk are shuffled.
``read_documents`` joins the chunks' ids themselves.

A chunk that many documents share leaves each encoding task once and is stored once;
recipes are spread by document. Null text counts as empty (the end id alone); a null
doc_id sorts first; repeated rows are documents of their own; an empty table gives an
empty store; columns other than the two are ignored.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bpe
from ._common import id_and_text, texts_of
from ._units import encode_array
from ._words import mix
from .packing import _rounds

DIGEST = 16
#: Ids that the rolling hash spans, and the least, mean and largest size of a chunk.
SPAN, LEAST, MEAN, MOST = 16, 64, 256, 1024

_STAGE = "kind string, digest binary, data binary, n int, width int, doc_id long, digests array<binary>, sizes array<int>, root binary"
_STAGE_TYPES = [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _h(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


class Merkle:
    """The root of a binary hash tree over leaves that arrive one by one; log n memory."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []
        self.n = 0

    def add(self, leaf: bytes) -> None:
        node, height = _h(b"\0" + leaf), 0
        while self.peaks and self.peaks[-1][0] == height:
            node, height = _h(b"\1" + self.peaks.pop()[1] + node), height + 1
        self.peaks.append((height, node))
        self.n += 1

    def root(self) -> bytes:
        node = _h(b"")
        for k, (_, peak) in enumerate(reversed(self.peaks)):
            node = peak if not k else _h(b"\1" + peak + node)
        return node


def merkle_root(leaves: list[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    x = mix(ids.astype(np.uint64) + np.uint64(1))
    rolled, factor = x[SPAN - 1 :].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(1, SPAN):
            factor = factor * _BASE
            rolled += x[SPAN - 1 - j : n - j] * factor
    marks = np.flatnonzero((mix(rolled) & np.uint64(MEAN - 1)) == 0) + SPAN
    ends, last = [], 0
    for p in marks.tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _stage(tokenizer: str, end_id: int):
    def run(batches):
        encoder, seen = _bpe.encoder(tokenizer), set()
        for batch in batches:
            for part in _rounds(batch):
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), encode_array(encoder, texts_of(part), end_id), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    digests, sizes, last = [], [], 0
                    for end in cut_points(ids):
                        digest = _h(raw[last * 4 : end * 4])
                        digests.append(digest)
                        sizes.append(end - last)
                        if digest not in seen:
                            seen.add(digest)
                            chunk = ids[last:end]
                            width = 2 if int(chunk.max()) < 1 << 16 else 4
                            rows.append(("chunk", digest, chunk.astype(f"<u{width}").tobytes(), end - last, width, None, None, None, None))
                        last = end
                    rows.append(("recipe", None, None, None, None, doc_id, digests, sizes, merkle_root(digests)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STAGE_TYPES, strict=True)], [x.split()[0] for x in _STAGE.split(", ")])

    return run


def _once(batches):
    """Drops chunks that an earlier row of the partition has; all copies of a digest meet here."""
    seen = set()
    for batch in batches:
        keep = []
        for digest in batch.column(1).to_pylist():
            keep.append(digest is None or digest not in seen)
            if digest is not None:
                seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


_RECIPE = "part int, row long, doc_id long, start long, n_tokens long, digests array<binary>, sizes array<int>, root binary"


def _ordered(batches):
    """Numbers the sorted recipes of a range and counts the ids before each."""
    part, row, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = [sum(s) for s in batch.column(2).to_pylist()]
        starts = start + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = batch.num_rows
        columns = [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), *(batch.column(i) for i in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _RECIPE.split(", ")])
        row, start = row + n, int(starts[-1])


def _roots(batches):
    """A row for each range: documents, ids and the Merkle root of the documents' roots."""
    trees: dict[int, list] = {}
    for batch in batches:
        for part, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = trees.setdefault(part, [Merkle(), 0])
            tree[0].add(root)
            tree[1] += n
    rows = [(p, t.n, n, t.root()) for p, (t, n) in sorted(trees.items())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["part", "n_docs", "n_ids", "root"])


def _ranges(recipes: DataFrame) -> list:
    """Ranges of the recipes in order. One row each reaches the driver: their number is that of the range partitions, not of the rows."""
    whole = recipes.select("part", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "row")
    return sorted(whole.select("part", "n_tokens", "root").mapInArrow(_roots, "part int, n_docs long, n_ids long, root binary").collect())


def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> str:
    """Writes the store under ``path``, a folder that all executors share; returns its root in hex."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = id_and_text(docs, id_col, text_col).mapInArrow(_stage(tokenizer, end_id), _STAGE)
    key = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id"))
    staged.repartition(n, key).mapInArrow(_once, _STAGE).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    recipes = spark.read.schema(_STAGE).parquet(f"{path}/store").where("kind = 'recipe'").select("doc_id", "digests", "sizes", "root")
    ordered = recipes.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "root").mapInArrow(_ordered, _RECIPE)
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    ranges, base, rows = _ranges(spark.read.schema(_RECIPE).parquet(f"{path}/recipes")), 0, []
    for part, n_docs, n_ids, root in ranges:
        rows.append((part, base, n_docs, n_ids, bytes(root)))
        base += n_ids
    spark.createDataFrame(rows, "part int, base long, n_docs long, n_ids long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    return merkle_root([r[4] for r in rows]).hex()


def _checked(batches):
    """Reads chunks: (digest, crc32 of the uint32 ids, n), after checking the digest."""
    for batch in batches:
        crcs, sizes = [], []
        for digest, data, n, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
            if _h(raw) != digest or len(raw) != 4 * n:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(raw))
            sizes.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], ["digest", "crc", "n"])


def _refs(batches):
    """A row for each chunk of each recipe, with the bytes that follow it, after checking the recipe's root."""
    for batch in batches:
        rows = []
        for part, row, digests, sizes, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if merkle_root(digests) != root:
                raise ValueError(f"recipe {part}/{row} is damaged")
            after = sum(sizes)
            for digest, size in zip(digests, sizes, strict=True):
                after -= size
                rows.append((part, row, digest, size, 4 * after))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()], strict=True)], ["part", "row", "digest", "size", "after"])


def _shift_tables() -> list[np.ndarray]:
    """For each b: what appending 2^b zero bytes does to a crc32, as tables by byte."""
    one = np.array([zlib.crc32(b"\0", int(v) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for v in (np.uint64(1) << np.arange(32, dtype=np.uint64))], np.uint32)
    tables = []
    for _ in range(48):
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                half = 1 << bit
                table[byte, half : 2 * half] = table[byte, :half] ^ one[8 * byte + bit]
        tables.append(table)
        one = _apply(table, one)
    return tables


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


def shifted_crc(crc: np.ndarray, after: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """What each crc32 adds to that of the whole stream when ``after`` bytes follow its part."""
    out = crc.astype(np.uint32)
    for b, table in enumerate(tables):
        at = np.flatnonzero((after >> b) & 1)
        if len(at):
            out[at] = _apply(table, out[at])
    return out


def _shifted(batches):
    tables = _shift_tables()
    for batch in batches:
        v = shifted_crc(batch.column(2).to_numpy(), batch.column(3).to_numpy(), tables)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v.astype(np.int64)), batch.column(4)], ["part", "row", "crc", "n"])


def _store(spark: SparkSession, path: str):
    chunks = spark.read.schema(_STAGE).parquet(f"{path}/store").where("kind = 'chunk'").select("digest", "data", "n", "width")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    manifest = spark.read.schema("part int, base long, n_docs long, n_ids long, root binary").parquet(f"{path}/manifest")
    return chunks, recipes, manifest


def verify_manifest(spark: SparkSession, path: str, root: str | None = None) -> None:
    """Raises ValueError unless recipes, manifest and, if given, its root agree."""
    _, recipes, manifest = _store(spark, path)
    kept = sorted((r.part, r.n_docs, r.n_ids, bytes(r.root)) for r in manifest.collect())
    if kept != [(p, d, n, bytes(r)) for p, d, n, r in _ranges(recipes)] or (root and merkle_root([r[3] for r in kept]).hex() != root):
        raise ValueError("manifest and recipes disagree")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files alone."""
    chunks, recipes, manifest = _store(spark, path)
    refs = recipes.select("part", "row", "digests", "sizes", "root").mapInArrow(_refs, "part int, row long, digest binary, size int, after long")
    found = chunks.mapInArrow(_checked, "digest binary, crc long, n int")
    joined = refs.join(found, "digest", "left").select("part", "row", F.when(F.col("n") == F.col("size"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing"))).cast("long").alias("crc"), "after", "n")
    crcs = joined.mapInArrow(_shifted, "part int, row long, crc long, n int").groupBy("part", "row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"))
    # One manifest row per range partition: a bounded table.
    placed = recipes.select("part", "row", "doc_id", "start", "n_tokens").join(F.broadcast(manifest.select("part", "base")), "part")
    return placed.join(crcs, ["part", "row"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("read").cast("long").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (little-endian uint32) of every document, joined from its chunks."""
    chunks, recipes, _ = _store(spark, path)

    def widened(batches):
        for batch in batches:
            raw = [np.frombuffer(d, f"<u{w}").astype("<u4").tobytes() for d, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["digest", "ids"])

    wide = chunks.select("digest", "data", "width").mapInArrow(widened, "digest binary, ids binary")
    refs = recipes.select("part", "row", "doc_id", F.posexplode("digests").alias("pos", "digest"))
    parts = refs.join(wide, "digest").groupBy("part", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            ids = [b"".join(p["ids"] for p in ps) for ps in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return parts.select("doc_id", "parts").mapInArrow(joined, "doc_id long, ids binary")
