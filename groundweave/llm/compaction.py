"""Size-tiered compaction of immutable shards under versioned manifests.

    table/data/<uuid>/part-*.parquet      shards, never changed
    table/manifests/00000000000000000007.json

``append`` writes arrivals as small shards and commits a manifest that adds them.
``compact`` sorts the live shards into tiers by size (tier k holds sizes from
``fan`` ** k times ``small_bytes``); a tier with ``fan`` shards or more is merged into
shards ``fan`` times as large, at most ``target_bytes``, and a manifest takes the new ones
for the old. Shards of the target size rest. A merge reads each shard once and writes
each row once, without a shuffle: whole shards of one tier are joined up by ``coalesce``.

A commit is one file that appears whole: it is written beside and renamed to the next
version without overwriting, so that of two writers one fails, reads again and repeats its
change on the newer manifest; a merge whose shards another one has taken is given up. That
rests on a rename that doesn't overwrite, as HDFS and local disks have it; on an object
store, commits need a lock or a conditional put beside it.

Readers take one manifest and see its shards whatever is committed meanwhile. Merging
removes nothing: ``vacuum`` alone does, by age, and leaves what a kept or young manifest
lists and young files that no manifest lists yet. A job that dies leaves files that no
manifest names.

Rows are kept as they are: nulls, repeated rows, long texts and all columns. An empty
table gives a manifest without rows. The driver holds the list of shards, not rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import path_of


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, *, small_bytes: int = 1 << 20, target_bytes: int = 128 << 20, fan: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.small_bytes, self.target_bytes, self.fan = small_bytes, target_bytes, fan

    # Manifests

    def versions(self) -> list[int]:
        fs, folder = path_of(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default; version 0 is an empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = path_of(self.spark, self._manifest_path(version))
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, base: dict, schema: str, shards: list[dict]) -> dict:
        """Makes the next version after ``base``; raises CommitConflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        made = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        fs, beside = path_of(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        final = path_of(self.spark, self._manifest_path(made["version"]))[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, final, none)
        except Exception as e:
            fs.delete(beside, False)
            if fs.exists(final):
                raise CommitConflict(f"version {made['version']} exists") from e
            raise
        return made

    # Shards

    def _write(self, rows: DataFrame, merges: int = 0) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._listed(folder, merges)

    def _listed(self, folder: str, merges: int = 0) -> list[dict]:
        fs, p = path_of(self.spark, folder)
        files = [s for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
        return [{"path": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen(), "merges": merges} for s in files]

    def _change(self, schema: str, gone: set[str], made: list[dict]) -> dict | None:
        """Commits on the newest manifest, however often others come first; None if a shard to replace isn't there any more."""
        while True:
            base = self.manifest()
            if base["schema"] not in (None, schema):
                raise ValueError("the rows have another schema than the table")
            if not gone <= {s["path"] for s in base["shards"]}:
                return None
            try:
                return self.commit(base, schema, [s for s in base["shards"] if s["path"] not in gone] + made)
            except CommitConflict:
                continue

    def append(self, rows: DataFrame) -> dict:
        """Adds the rows as small shards, one at least for each input partition, and commits."""
        return self._change(rows.schema.json(), set(), self._write(rows))

    def append_arrivals(self, rows: DataFrame, arrival) -> dict:
        """Adds the rows of each value of the expression ``arrival`` by a commit of its own; one job writes them all."""
        folder, name = f"{self.path}/data/{uuid.uuid4().hex}", f"arrival{uuid.uuid4().hex[:8]}"
        rows.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        fs, p = path_of(self.spark, folder)
        found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        made = self._change(rows.schema.json(), set(), []) if not found else None
        for each in found:
            made = self._change(rows.schema.json(), set(), self._listed(f"{folder}/{each}"))
        return made

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        found = self.manifest(version)
        schema = StructType.fromJson(json.loads(found["schema"]))
        if not found["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in found["shards"]])

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.small_bytes, self.fan) + 1)) if size >= self.small_bytes else 0

    def plan(self, shards: list[dict], force: bool = False) -> list[list[dict]]:
        """Runs of similarly sized shards to merge: tiers of at least ``fan`` shards (two, if forced) below the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target_bytes // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [sorted(t, key=lambda s: s["path"]) for _, t in sorted(tiers.items()) if len(t) >= (2 if force else self.fan)]

    def merges(self, force: bool = False) -> Iterator[dict]:
        """Merges tiers, the smallest first, until none is due; yields each manifest that it commits."""
        while runs := self.plan((base := self.manifest())["shards"], force):
            run = runs[0]
            total = sum(s["bytes"] for s in run)
            size = min(self.target_bytes, max(self.fan * total // len(run), self.small_bytes))
            parts = max(1, min(round(total / size), len(run) // 2))
            rows = self.spark.read.schema(self.read(base["version"]).schema).parquet(*[s["path"] for s in run])
            merged = self._write(rows.coalesce(parts), 1 + max(s.get("merges", 0) for s in run))
            made = self._change(base["schema"], {s["path"] for s in run}, merged)
            if made:
                yield made

    def compact(self, force: bool = False) -> dict:
        """Merges until none is due; returns the newest manifest."""
        for _ in self.merges(force):
            pass
        return self.manifest()

    def vacuum(self, keep: int = 10, least_age: float = 86_400.0) -> None:
        """Removes old versions' manifests and shards.

        The last ``keep`` manifests and those younger than ``least_age`` seconds stay with
        their shards, and so do files of that age that no manifest lists, as a writer may be
        about to commit them. A reader or writer that takes longer needs a larger age.
        """
        fs, folder = path_of(self.spark, f"{self.path}/data")
        before = (time.time() - least_age) * 1000
        versions = self.versions()
        old = [v for v in versions[:-keep] if fs.getFileStatus(path_of(self.spark, self._manifest_path(v))[1]).getModificationTime() <= before]
        live = {s["path"].rsplit("/data/", 1)[1] for v in versions if v not in old for s in self.manifest(v)["shards"]}
        for v in old:
            fs.delete(path_of(self.spark, self._manifest_path(v))[1], False)
        if fs.exists(folder):
            self._sweep(fs, folder, "", live, before)

    def _sweep(self, fs, folder, name: str, live: set[str], before: float) -> None:
        for status in fs.listStatus(folder):
            path = f"{name}{status.getPath().getName()}"
            if status.isDirectory():
                self._sweep(fs, status.getPath(), f"{path}/", live, before)
            elif path not in live and status.getModificationTime() <= before:
                fs.delete(status.getPath(), False)
        if name and not fs.listStatus(folder) and fs.getFileStatus(folder).getModificationTime() <= before:
            fs.delete(folder, False)

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def read_merges(self, version: int | None = None) -> DataFrame:
        """The rows and, as ``merges``, how often each row's shard was merged."""
        shards = self.manifest(version)["shards"]
        out = self.read(version).limit(0).withColumn("merges", F.lit(0))
        for n in sorted({s["merges"] for s in shards}):
            some = self.spark.read.schema(self.read(version).schema).parquet(*[s["path"] for s in shards if s["merges"] == n])
            out = out.union(some.withColumn("merges", F.lit(n)))
        return out
