"""Vector and raster files and tile archives as formats of ``spark.read`` and ``df.write``, after ``register_formats(spark)``.

| format | reads | writes | options |
| --- | --- | --- | --- |
| gw_geojson | feature collections | yes | multi (a feature a line), bbox, asWKB |
| gw_geojsonl | a feature a line, by byte ranges | yes | bbox, asWKB, maxRecordsPerFile |
| gw_shapefile | .shp with its .shx and .dbf, by record ranges | yes | chunkSize, bbox, asWKB |
| gw_gpkg | a layer, by row ranges | yes | layerName, layerNumber, chunkSize, bbox, asWKB |
| gw_raster, gw_gtiff | GeoTIFF files, a partition each | yes | filterRegex, sizeInMB, bbox; nameCol, ext |
| gw_pmtiles | (z, x, y, bytes) of archives | yes | minZoom, maxZoom, bbox; shardZoom, fileName, metadata |

A vector row holds the attributes, ``geom_0`` (WKB, or WKT without asWKB), ``geom_0_srid``
and ``geom_0_srid_proj``. ``bbox`` (xmin,ymin,xmax,ymax) keeps what its envelope meets.
Paths are files or folders on any store that Arrow opens and all machines share.

Writers make one file a partition (of shapefiles: three), in a folder; ``coalesce(1)``
makes one. Tasks write under ``_temporary`` and the commit moves whole files, so that a
task that is run again, or a job that fails, leaves nothing half done. An existing folder
that isn't empty is an error, or is emptied at the commit of a mode of overwrite.
"""

from __future__ import annotations

import io
import itertools
import json
import math
import re
import sqlite3
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import geometry
from ..raster import kernels
from ..raster.codec import decode, encode
from ..vector import tiles
from .files import _records, _shapes, from_geojson, to_geojson

TILE = "struct<cellid: bigint, raster: binary, metadata: map<string, string>>"
_GEOMETRY = [T.StructField("geom_0", T.BinaryType()), T.StructField("geom_0_srid", T.StringType()), T.StructField("geom_0_srid_proj", T.StringType())]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, its path) of a path or URI."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str, *ends: str, pattern: str = "") -> list[str]:
    """Files of a folder and those below it, or the one file, with these endings."""
    store, name = store_of(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.is_file else store.get_file_info(fs.FileSelector(name, recursive=True))
    found = sorted(i.path for i in every if i.is_file and i.path.lower().endswith(ends or ("",)) and not re.search(r"/[_.][^/]*", i.path.removeprefix(name)))
    return [f for f in found if re.search(pattern, f)]


def content(path: str, source: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file of the store of ``path``."""
    with store_of(path)[0].open_input_file(source) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


@dataclass
class Part(InputPartition):
    """What a task reads: a file and a range of its records or bytes."""

    source: str
    start: int = 0
    end: int = -1

    def __init__(self, source: str, start: int = 0, end: int = -1):
        super().__init__((source, start, end))
        self.source, self.start, self.end = source, start, end


#: Tasks of a vector reader at most.
MAX_TASKS = 256


@dataclass
class Parts(InputPartition):
    """What a task of a vector reader reads, in this order."""

    parts: list[Part]

    def __init__(self, parts: list[Part]):
        super().__init__([(p.source, p.start, p.end) for p in parts])
        self.parts = parts


def _box(text: str | None) -> tuple[float, ...] | None:
    return tuple(float(v) for v in text.split(",")) if text else None


def _meets(bounds, box) -> bool:
    return box is None or bounds is not None and bounds[0] <= box[2] and bounds[2] >= box[0] and bounds[1] <= box[3] and bounds[3] >= box[1]


def _kind_of(values: list) -> T.DataType:
    found = {type(v) for v in values if v is not None}
    if found <= {bool} and found:
        return T.BooleanType()
    if found <= {int} and found:
        return T.LongType()
    return T.DoubleType() if found and found <= {int, float} else T.StringType()


def _cast(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    return float(value) if isinstance(kind, T.DoubleType) else int(value) if isinstance(kind, T.LongType) else value


# Vector formats: each gives its parts, and (attributes, WKB, EPSG code) of a part


class Vector(DataSource):
    ends: tuple[str, ...] = ()

    def schema(self) -> T.StructType:
        """Attributes of the first part's features, of up to ``inferenceLimit`` (1000) of them."""
        rows: dict[str, list] = {}
        limit = int(self.options.get("inferenceLimit", 1000))
        for part in self.parts():
            for _, (attributes, _, _) in zip(range(limit), self.features(part), strict=False):
                for k, v in attributes.items():
                    rows.setdefault(k, []).append(v)
            if rows:
                break
        geom = [T.StructField("geom_0", T.BinaryType() if self.as_wkb else T.StringType()), *_GEOMETRY[1:]]
        return T.StructType([*(T.StructField(k, _kind_of(v)) for k, v in rows.items()), *geom])

    @property
    def path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return self.options["path"]

    @property
    def as_wkb(self) -> bool:
        return self.options.get("asWKB", "true").lower() == "true"

    def parts(self) -> list[Part]:
        return [Part(f) for f in listed(self.path, *self.ends)]

    def features(self, part: Part):
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return VectorReader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self, schema, overwrite)

    def files_of(self, rows, schema: T.StructType):
        """(ending, bytes) of the files of one task's rows."""
        raise NotImplementedError


class VectorReader(DataSourceReader):
    def __init__(self, source: Vector, schema: T.StructType):
        self.source, self.schema = source, schema
        self.box = _box(source.options.get("bbox"))

    def partitions(self):
        """Up to MAX_TASKS tasks of as many parts each, which follow one another: a task by itself costs more than a small part."""
        parts = self.source.parts()
        step = -(-len(parts) // MAX_TASKS) or 1
        return [Parts(parts[k : k + step]) for k in range(0, len(parts), step)] or [Parts([])]

    def read(self, some):
        plain = [f for f in self.schema.fields if f.name not in {g.name for g in _GEOMETRY}]
        for attributes, wkb, srid in itertools.chain.from_iterable(map(self.source.features, some.parts)):
            if self.box is not None and (wkb is None or not _meets(geometry.parse(wkb).bounds(), self.box)):
                continue
            shown = wkb if wkb is None or self.source.as_wkb else wkt(geometry.parse(wkb))
            made = {f.name: _cast(attributes.get(f.name), f.dataType) for f in plain} | {"geom_0": shown, "geom_0_srid": str(srid), "geom_0_srid_proj": ""}
            yield tuple(made[f.name] for f in self.schema.fields)


def wkt(g: geometry.Geometry) -> str:
    """Well-known text, with the shortest digits that read back alike."""
    pair = lambda c: " ".join(repr(float(v)) for v in c)
    run = lambda c: "(" + ", ".join(map(pair, c)) + ")"
    polygon = lambda p: "(" + ", ".join(map(run, p)) + ")"
    name = {v: k for k, v in geometry._NAMES.items()}[g.kind]
    if not g.parts:
        return f"{name} EMPTY"
    bodies = {1: lambda: run(g.parts[0]), 2: lambda: run(g.parts[0]), 3: lambda: polygon(g.parts[0]), 4: lambda: run([p[0] for p in g.parts]), 5: lambda: polygon(g.parts), 6: lambda: "(" + ", ".join(map(polygon, g.parts)) + ")"}
    return f"{name} {bodies[g.kind]()}"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FileWriter(DataSourceWriter):
    """Files that tasks write aside and the commit moves into place."""

    def __init__(self, source, schema: T.StructType, overwrite: bool):
        self.source, self.schema, self.overwrite = source, schema, overwrite
        store, self.folder = store_of(source.path)
        self.aside = f"{self.folder.rstrip('/')}/_temporary/{uuid.uuid4().hex}"
        info = store.get_file_info(self.folder)
        if not overwrite and (info.is_file or info.type == fs.FileType.Directory and listed(source.path)):
            raise FileExistsError(f"{source.path} isn't empty; write it in mode overwrite")

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, task, made = store_of(self.source.path)[0], TaskContext.get(), []
        store.create_dir(self.aside, recursive=True)
        rows = iter(iterator)
        first = next(rows, None)
        if first is None and task.partitionId():
            return Written([])  # one task at least leaves a file, of no rows
        for name, data in self.source.files_of(itertools.chain([] if first is None else [first], rows), self.schema):
            name = name if name[0] != "." else f"part-{task.partitionId():05d}-{task.taskAttemptId()}{name}"
            if "/" in name:
                store.create_dir(f"{self.aside}/{name}".rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{self.aside}/{name}") as f:
                f.write(data)
            made.append(name)
        return Written(made)

    def commit(self, messages) -> None:
        store = store_of(self.source.path)[0]
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(self.folder)):
                if info.base_name != "_temporary":
                    store.delete_dir(info.path) if info.type == fs.FileType.Directory else store.delete_file(info.path)
        names = [n for m in messages if m for n in m.files]
        if len(set(names)) < len(names):
            raise ValueError("two rows name one file")
        for name in names:
            target = f"{self.folder.rstrip('/')}/{name}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            store.move(f"{self.aside}/{name}", target)
        store.delete_dir(f"{self.folder.rstrip('/')}/_temporary")

    def abort(self, messages) -> None:
        store = store_of(self.source.path)[0]
        if store.get_file_info(self.aside).type == fs.FileType.Directory:
            store.delete_dir(self.aside)


def _attributes(row, schema: T.StructType, geom: str = "geom_0") -> tuple[dict, geometry.Geometry | None, int]:
    values = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(zip(schema.names, row, strict=True))
    shape = values.pop(geom, None)
    srid = values.pop(f"{geom}_srid", None)
    values.pop(f"{geom}_srid_proj", None)
    g = geometry.parse(bytes(shape) if isinstance(shape, (bytes, bytearray)) else shape)
    return values, g, int(srid) if srid and str(srid).isdigit() else (g.srid if g and g.srid else 4326)


class GeoJSON(Vector):
    ends = (".geojson", ".json")

    @classmethod
    def name(cls):
        return "gw_geojson"

    @property
    def lines(self) -> bool:
        return self.options.get("multi", "false").lower() == "true"

    def parts(self):
        if not self.lines:
            return super().parts()
        size, store = int(self.options.get("splitBytes", 32 << 20)), store_of(self.path)[0]
        every = [(f, store.get_file_info(f).size) for f in listed(self.path, *self.ends)]
        return [Part(f, a, min(a + size, n)) for f, n in every for a in range(0, max(n, 1), size)]

    def features(self, part):
        if not self.lines:
            found = json.loads(content(self.path, part.source))
            texts = found.get("features", []) if found.get("type") == "FeatureCollection" else [found]
        else:
            texts = map(json.loads, self._whole_lines(part))
        for f in texts:
            g = from_geojson(f.get("geometry"))
            yield f.get("properties") or {}, None if g is None else geometry.to_wkb(g), 4326

    def _whole_lines(self, part):
        """Lines that begin in the part's bytes."""
        with io.BufferedReader(store_of(self.path)[0].open_input_file(part.source)) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.end and (line := f.readline()):
                at += len(line)
                if line.strip():
                    yield line

    def files_of(self, rows, schema):
        most, held = int(self.options.get("maxRecordsPerFile", 0)), []
        count = 0
        for row in rows:
            values, g, _ = _attributes(row, schema)
            held.append(json.dumps({"type": "Feature", "properties": values, "geometry": None if g is None else to_geojson(g)}, default=str, ensure_ascii=False))
            if most and len(held) == most:
                yield self._file(held, count)
                held, count = [], count + 1
        if held or not count:
            yield self._file(held, count)

    def _file(self, features: list[str], k: int):
        body = "".join(f + "\n" for f in features) if self.lines else '{"type":"FeatureCollection","features":[' + ",\n".join(features) + "]}"
        return f".{k:03d}{self.ends[0]}", body.encode()


class GeoJSONLines(GeoJSON):
    ends = (".geojsonl", ".ndjson", ".geojsonseq")

    @classmethod
    def name(cls):
        return "gw_geojsonl"

    @property
    def lines(self):
        return True


class Shapefile(Vector):
    ends = (".shp",)

    @classmethod
    def name(cls):
        return "gw_shapefile"

    def parts(self):
        chunk, out = int(self.options.get("chunkSize", 10_000)), []
        for f in listed(self.path, *self.ends):
            store = store_of(self.path)[0]
            index = store.get_file_info(f[:-4] + ".shx")
            n = (index.size - 100) // 8 if index.is_file else None
            out += [Part(f)] if n is None else [Part(f, a, min(a + chunk, n)) for a in range(0, max(n, 1), chunk)]
        return out

    def features(self, part):
        stem, store = part.source[:-4], store_of(self.path)[0]
        if part.end < 0:
            shapes = _shapes(content(self.path, part.source))
        else:
            index = np.frombuffer(content(self.path, stem + ".shx", 100 + 8 * part.start, 8 * (part.end - part.start)), ">i4").reshape(-1, 2).astype(np.int64) * 2
            first, last = (int(index[0, 0]), int(index[-1].sum()) + 8) if len(index) else (100, 100)
            shapes = _shapes(b"\0" * 100 + content(self.path, part.source, first, last - first))
        end = part.start + len(shapes)
        table = store.get_file_info(stem + ".dbf")
        rows = [{}] * len(shapes)
        if table.is_file:
            head = content(self.path, stem + ".dbf", 0, 32)
            _, skip, size = struct.unpack_from("<IHH", head, 4)
            head = content(self.path, stem + ".dbf", 0, skip)
            body = content(self.path, stem + ".dbf", skip + size * part.start, size * (end - part.start))
            page = store.get_file_info(stem + ".cpg")
            utf = page.is_file and content(self.path, stem + ".cpg").strip().upper() in (b"UTF-8", b"65001")
            rows = _records(head[:4] + struct.pack("<I", len(body) // size) + head[8:] + body, "utf-8" if utf else "latin-1")
        for row, wkb in zip(rows, shapes, strict=False):
            yield row, wkb, int(self.options.get("srid", 4326))

    def files_of(self, rows, schema):
        every = [_attributes(r, schema) for r in rows]
        yield from zip((".shp", ".shx", ".dbf", ".cpg"), (*_shp([g for _, g, _ in every]), _dbf([v for v, _, _ in every], schema), b"UTF-8"), strict=True)


# Shapefile types by WKB type.
_SHAPE = {1: 1, 2: 3, 3: 5, 4: 8, 5: 3, 6: 5}


def _shp(shapes: list[geometry.Geometry | None]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of shapes of one sort; missing ones are null shapes."""
    kinds = {_SHAPE[g.kind] for g in shapes if g is not None}
    if len(kinds) > 1:
        raise ValueError("a shapefile holds shapes of one sort")
    kind = kinds.pop() if kinds else 0
    records, places, at = [], [], 100
    for k, g in enumerate(shapes):
        body = struct.pack("<i", 0 if g is None or not g.parts else kind) + (b"" if g is None or not g.parts else _shape(g, kind))
        records.append(struct.pack(">ii", k + 1, len(body) // 2) + body)
        places.append(struct.pack(">ii", at // 2, len(body) // 2))
        at += len(body) + 8
    bounds = [b for g in shapes if g is not None and (b := g.bounds())]
    box = [f(b[k] for b in bounds) if bounds else 0.0 for k, f in enumerate((min, min, max, max))]
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii4d32x", 1000, kind, *box)
    return head(at) + b"".join(records), head(100 + 8 * len(shapes)) + b"".join(places)


def _shape(g: geometry.Geometry, kind: int) -> bytes:
    flat = lambda c: np.ascontiguousarray(c[:, :2], "<f8").tobytes()
    if kind == 1:
        return flat(g.parts[0])
    box = struct.pack("<4d", *g.bounds())
    if kind == 8:
        return box + struct.pack("<i", len(g.parts)) + b"".join(map(flat, g.parts))
    lines = g.parts
    if kind == 5:  # shells clockwise, holes the other way
        turn = lambda r: float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())
        lines = [r if (turn(r) <= 0) == (k == 0) else r[::-1] for p in g.parts for k, r in enumerate(p)]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in lines])]).astype("<i4")
    return box + struct.pack("<ii", len(lines), int(starts[-1])) + starts[:-1].tobytes() + b"".join(map(flat, lines))


def _dbf(rows: list[dict], schema: T.StructType) -> bytes:
    """A dBASE table; names are cut to ten bytes and kept apart by numbers, texts to 254 bytes."""
    fields, used = [], set()
    for f in schema.fields:
        if f.name in {g.name for g in _GEOMETRY}:
            continue
        short, k = f.name.encode()[:10], 1
        while short in used:
            end = f"_{k}".encode()
            short, k = f.name.encode()[: 10 - len(end)] + end, k + 1
        used.add(short)
        kind, width, places = ("L", 1, 0) if isinstance(f.dataType, T.BooleanType) else ("N", 20, 0) if isinstance(f.dataType, T.IntegralType) else ("F", 25, 0) if isinstance(f.dataType, T.FractionalType) else ("C", 254, 0)
        fields.append((f.name, short, kind, width, places))

    def text(value, kind, width) -> bytes:
        if value is None:
            return b" " * width
        raw = ("T" if value else "F") if kind == "L" else repr(float(value)) if kind == "F" else str(value)
        if kind != "C" and len(raw) > width:
            raise ValueError(f"{raw} needs more than {width} signs")
        raw = raw.encode()[:width].decode("utf-8", "ignore").encode()
        return raw.ljust(width) if kind == "C" else raw.rjust(width)

    size = 1 + sum(f[3] for f in fields)
    head = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    head += b"".join(short.ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, places]) + b"\0" * 14 for _, short, kind, width, places in fields) + b"\r"
    return head + b"".join(b" " + b"".join(text(r.get(name), kind, width) for name, _, kind, width, _ in fields) for r in rows) + b"\x1a"


class GeoPackage(Vector):
    ends = (".gpkg",)

    @classmethod
    def name(cls):
        return "gw_gpkg"

    def _open(self, source: str) -> tuple[sqlite3.Connection, str, str]:
        db = sqlite3.connect(":memory:")
        db.deserialize(content(self.path, source))
        layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        name = self.options.get("layerName") or layers[int(self.options.get("layerNumber", 0))][0]
        return db, name, dict(layers)[name]

    def parts(self):
        chunk, out = int(self.options.get("chunkSize", 10_000)), []
        for f in listed(self.path, *self.ends):
            db, name, _ = self._open(f)
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
            out += [Part(f, a, a + chunk) for a in range(low, high + 1, chunk)] if low is not None else [Part(f, 0, 0)]
        return out

    def features(self, part):
        db, name, column = self._open(part.source)
        cursor = db.execute(f'SELECT * FROM "{name}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (part.start, part.end))
        names = [d[0] for d in cursor.description]
        booleans = {r[1] for r in db.execute(f'PRAGMA table_info("{name}")') if r[2].upper() == "BOOLEAN"}
        for values in cursor:
            row = dict(zip(names, values, strict=True))
            row |= {k: None if row[k] is None else bool(row[k]) for k in booleans}
            blob = row.pop(column)
            srid = struct.unpack_from("<i" if blob[3] & 1 else ">i", blob, 4)[0] if blob else 0
            skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
            yield {k: v for k, v in row.items() if k != "fid" and not isinstance(v, bytes)}, bytes(blob[skip:]) if blob else None, srid

    def files_of(self, rows, schema):
        name = self.options.get("layerName", "layer")
        db = sqlite3.connect(":memory:")
        db.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT NOT NULL DEFAULT '2000-01-01T00:00:00Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));"
        )
        plain = [f for f in schema.fields if f.name not in {g.name for g in _GEOMETRY}]
        sort = lambda f: "BOOLEAN" if isinstance(f.dataType, T.BooleanType) else "INTEGER" if isinstance(f.dataType, T.IntegralType) else "DOUBLE" if isinstance(f.dataType, T.FractionalType) else "TEXT"
        columns = "".join(f', "{f.name}" {sort(f)}' for f in plain)
        db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{columns})')
        srids, boxes = {4326}, []

        def prepared():
            for row in rows:
                values, g, srid = _attributes(row, schema)
                srids.add(srid)
                if g is not None and (b := g.bounds()):
                    boxes.append(b)
                blob = None if g is None else struct.pack("<2sBBi", b"GP", 0, 1, srid) + geometry.to_wkb(g)
                yield (blob, *(v if v is None or isinstance(v, (int, float, str, bool)) else str(v) for v in (values[f.name] for f in plain)))

        db.executemany(f'INSERT INTO "{name}" (geom{"".join(f", \"{f.name}\"" for f in plain)}) VALUES (?{", ?" * len(plain)})', prepared())
        srid = max(srids - {4326}, default=4326)
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', '')", [("Undefined Cartesian", -1, "NONE", -1), ("Undefined geographic", 0, "NONE", 0), *((f"EPSG:{s}", s, "EPSG", s) for s in sorted(srids) if s > 0)])
        box = [f(b[k] for b in boxes) if boxes else None for k, f in enumerate((min, min, max, max))]
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (name, name, *box, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 2, 0)", (name, srid))
        db.commit()
        yield ".gpkg", db.serialize()


# Rasters


class RasterFiles(DataSource):
    @classmethod
    def name(cls):
        return "gw_raster"

    def schema(self):
        return f"source string, tile {TILE}"

    path = Vector.path

    def reader(self, schema):
        return RasterReader(self.options, self.path)

    def writer(self, schema, overwrite):
        if "tile" not in schema.names:
            raise ValueError("a column tile is needed")
        return FileWriter(self, schema, overwrite)

    def files_of(self, rows, schema):
        named, end = self.options.get("nameCol"), self.options.get("ext", "tif").lstrip(".")
        for k, row in enumerate(rows):
            if row["tile"] is not None and row["tile"]["raster"] is not None:
                yield (f"{row[named]}.{end}" if named else f".{k:05d}.{end}"), bytes(row["tile"]["raster"])


class RasterReader(DataSourceReader):
    def __init__(self, options, path: str):
        self.path, self.pattern, self.box, self.size = path, options.get("filterRegex", ""), _box(options.get("bbox")), float(options.get("sizeInMB", -1))

    def partitions(self):
        return [Part(f) for f in listed(self.path, ".tif", ".tiff", pattern=self.pattern)] or [Part("")]

    def read(self, part):
        if not part.source:
            return
        data = content(self.path, part.source)
        made = [data]
        if self.box is not None or self.size > 0:
            r = decode(data)
            if self.box is not None:
                if not _meets(r.bounds(), self.box):
                    return
                r = _cut(r, self.box)
            made = [encode(p) for p in (kernels.maketiles(r, self.size) if self.size > 0 else [r])]
        for one in made:
            yield part.source, (0, one, {"driver": "GTiff"})


def _cut(r, box):
    """The raster's window of whole pixels that the box touches."""
    cols, rows = zip(*(r.colrow(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])), strict=True)
    inside = lambda v, n: int(min(max(v, 0), n))
    c0, c1 = inside(math.floor(min(cols)), r.width - 1), inside(math.ceil(max(cols)), r.width)
    r0, r1 = inside(math.floor(min(rows)), r.height - 1), inside(math.ceil(max(rows)), r.height)
    return r.window(c0, r0, max(1, c1 - c0), max(1, r1 - r0))


class GeoTIFF(RasterFiles):
    @classmethod
    def name(cls):
        return "gw_gtiff"


# Tile archives


def shard_of(z: int, x: int, y: int, shard_zoom: int) -> str:
    """The archive that a tile belongs to: that of its parent at the shard zoom, or the overview's above it."""
    if shard_zoom <= 0:
        return "tiles"
    return "overview" if z < shard_zoom else f"{shard_zoom}-{x >> (z - shard_zoom)}-{y >> (z - shard_zoom)}"


class PMTiles(DataSource):
    """Reads (z, x, y, bytes). Writes one archive for each shard of a task's tiles: bring a shard's tiles together
    with ``repartition(shard_column("z", "x", "y", zoom))`` first, as tasks that share one would name one file."""

    @classmethod
    def name(cls):
        return "gw_pmtiles"

    def schema(self):
        return "z int, x int, y int, bytes binary"

    path = Vector.path

    def reader(self, schema):
        return PMTilesReader(self.options, self.path)

    def writer(self, schema, overwrite):
        if [f.name for f in schema.fields] != ["z", "x", "y", "bytes"]:
            raise ValueError("the columns must be z, x, y, bytes")
        return FileWriter(self, schema, overwrite)

    def files_of(self, rows, schema):
        zoom, shards = int(self.options.get("shardZoom", 6)), {}
        for z, x, y, data in rows:
            if data is not None:
                shards.setdefault(shard_of(z, x, y, zoom), []).append((z, x, y, bytes(data)))
        for name, found in sorted(shards.items()):
            yield (f"{self.options.get('fileName', 'tiles')}.pmtiles" if zoom <= 0 else f"{name}.pmtiles"), tiles.pmtiles(sorted(found), json.loads(self.options.get("metadata", "{}")))


class PMTilesReader(DataSourceReader):
    def __init__(self, options, path):
        self.path, self.low, self.high, self.box = path, int(options.get("minZoom", 0)), int(options.get("maxZoom", 26)), _box(options.get("bbox"))

    def partitions(self):
        return [Part(f) for f in listed(self.path, ".pmtiles")] or [Part("")]

    def read(self, part):
        if not part.source:
            return
        for i, data in sorted(tiles.read_pmtiles(content(self.path, part.source))[1].items()):
            z, x, y = tiles.hilbert_tile(i)
            if self.low <= z <= self.high and _meets(tiles.tile_bounds(z, x, y), self.box):
                yield z, x, y, data


def shard_column(z, x, y, shard_zoom: int):
    """``shard_of`` as a column, to bring a shard's tiles together."""
    from pyspark.sql import functions as F

    from ..functions.wkb import col

    if shard_zoom <= 0:
        return F.lit("tiles")
    up = lambda v: F.call_function("shiftright", col(v).cast("int"), (col(z) - shard_zoom).cast("int")).cast("string")
    return F.when(col(z) < shard_zoom, F.lit("overview")).otherwise(F.concat_ws("-", F.lit(str(shard_zoom)), up(x), up(y)))


FORMATS = (GeoJSON, GeoJSONLines, Shapefile, GeoPackage, RasterFiles, GeoTIFF, PMTiles)


def register_formats(spark: SparkSession) -> list[str]:
    """Makes the formats known to the session; returns their names."""
    for f in FORMATS:
        spark.dataSource.register(f)
    return [f.name() for f in FORMATS]
