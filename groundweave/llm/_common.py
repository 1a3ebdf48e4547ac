"""What the operators of this subpackage share: columns, shared folders, bounded sketches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share.

    It lies under spark.checkpoint.dir. Where that is unset, as in tests, a folder of this
    machine is taken and set as the checkpoint folder, but only under a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='groundweave-')}"
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/groundweave-{name}-{uuid.uuid4().hex}"


def path_of(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): file actions work on any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


#: Under it Spark removes the shuffle files of a query when that query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame written once as Parquet and read back: lineage ends in files that all executors see.

    The shuffle files behind it go when it is written.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before) if before else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so others can't clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def trim() -> None:
    """Gives a worker's freed memory back, so that reused workers don't hold the peak of each task they had."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Cells of a sketch that travel as one row.
BLOCK = 1 << 14


def sketch_blocks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block number, little-endian uint16 cells, saturating) of the blocks that hold anything."""
    for b in range(0, len(cells), BLOCK):
        part = cells[b : b + BLOCK]
        if part.any():
            yield b // BLOCK, np.minimum(part, 2**16 - 1).astype("<u2").tobytes()


def merged_sketch(blocks: DataFrame, size: int) -> np.ndarray:
    """Sum of all tasks' sketches, block by block on the executors; ``size`` cells reach the driver.

    Sums saturate at 2^32-1. Its size is a parameter and doesn't grow with the data.
    """

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(cells, "<u2")
                if b not in total:
                    total[b] = np.zeros(len(part), np.uint64)
                total[b] += part
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([np.minimum(total[k], 2**32 - 1).astype("<u4").tobytes() for k in keys], pa.binary())],
            ["block", "cells"],
        )

    out = np.zeros(size, np.uint32)
    parts = max(1, min(64, size // BLOCK))
    rows = blocks.select(F.col("block").cast("int"), "cells").repartition(parts, "block").mapInArrow(add, "block int, cells binary").collect()
    for r in rows:
        out[r.block * BLOCK : r.block * BLOCK + BLOCK] = np.frombuffer(r.cells, "<u4")
    return out


def bit_places(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of each id in a table of ``size`` bits (a power of two)."""
    x = values.astype(np.int64).view(np.uint64)
    return [((x * np.uint64(f)) >> np.uint64(20)).astype(np.int64) & (size - 1) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def bit_table(ids: DataFrame, least: int = 1 << 20, most: int = 1 << 27) -> np.ndarray:
    """Packed bits that have all these ids (one long column); others pass by chance and must fall away elsewhere.

    16 bits an id, from 128 KB to 16 MB: a bound for what is broadcast, whatever the data.
    """
    size = min(most, max(least, 1 << (16 * max(1, ids.count()) - 1).bit_length()))

    def mark(batches):
        table = np.zeros(size, np.uint8)
        for batch in batches:
            for places in bit_places(batch.column(0).to_numpy(zero_copy_only=False), size):
                table[places] = 1
        packed = np.packbits(table)
        yield pa.RecordBatch.from_arrays(_nonzero(packed), ["block", "bits"])

    def both(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(bits, np.uint8)
                total[b] = total[b] | part if b in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "bits"])

    out = np.zeros(size // 8, np.uint8)
    kind = "block int, bits binary"
    for r in ids.mapInArrow(mark, kind).repartition(max(1, min(64, size // 8 // BLOCK)), "block").mapInArrow(both, kind).collect():
        out[r.block * BLOCK : r.block * BLOCK + BLOCK] = np.frombuffer(r.bits, np.uint8)
    return out


def _nonzero(packed: np.ndarray) -> list[pa.Array]:
    blocks = [b for b in range(0, len(packed), BLOCK) if packed[b : b + BLOCK].any()]
    return [pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array([packed[b : b + BLOCK].tobytes() for b in blocks], pa.binary())]


def in_table(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    places = bit_places(ids, len(table) * 8)
    return np.logical_and.reduce([(table[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in places]).astype(bool)
