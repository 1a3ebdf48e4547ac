"""Readers and writers of vector files as DataFrames; bytes come through Spark's own readers, so any store works."""

from __future__ import annotations

import json
import sqlite3
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry

_FEATURE = T.ArrayType(T.StructType([T.StructField("properties", T.StringType()), T.StructField("geom_0", T.BinaryType())]))


def from_geojson(g: dict | None) -> geometry.Geometry | None:
    if not g or not g.get("coordinates"):
        return None
    kind = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[g["type"]]
    c = g["coordinates"]
    a = lambda v: np.array(v, float)
    parts = {1: lambda: [a([c])], 2: lambda: [a(c)], 3: lambda: [[a(r) for r in c]], 4: lambda: [a([p]) for p in c], 5: lambda: [a(v) for v in c], 6: lambda: [[a(r) for r in p] for p in c]}[kind]()
    return geometry.Geometry(kind, parts, 4326)


def to_geojson(g: geometry.Geometry) -> dict:
    plain = lambda c: c.tolist()
    names = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
    body = {1: lambda: plain(g.parts[0])[0], 2: lambda: plain(g.parts[0]), 3: lambda: [plain(r) for r in g.parts[0]], 4: lambda: [plain(p)[0] for p in g.parts], 5: lambda: [plain(p) for p in g.parts], 6: lambda: [[plain(r) for r in p] for p in g.parts]}[g.kind]()
    return {"type": names[g.kind], "coordinates": body}


@F.pandas_udf(T.BinaryType())
def _geojson_wkb(values: pd.Series) -> pd.Series:
    made = [None if v is None else from_geojson(json.loads(v)) for v in values]
    return pd.Series([None if g is None else geometry.to_wkb(g) for g in made], dtype=object)


@F.pandas_udf(T.StringType())
def _wkb_geojson(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else json.dumps(to_geojson(geometry.parse(v))) for v in values], dtype=object)


def _typed(rows: DataFrame, properties: str) -> DataFrame:
    """Attribute columns with inferred types from JSON text, beside geom_0 and its system."""
    spark = rows.sparkSession
    texts = getattr(rows.where(f"{properties} is not null").select(properties)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = DataFrame(spark._jsparkSession.read().json(texts), spark).schema
    named = rows.withColumn("p", F.from_json(properties, schema))
    return named.select(*(F.col("p").getField(f.name).alias(f.name) for f in schema.fields), "geom_0", F.lit("4326").alias("geom_0_srid"), F.lit("").alias("geom_0_srid_proj"))


def read_geojson(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """Features of GeoJSON collections, or with ``multi`` of one feature a line."""
    if multi:
        feature = spark.read.text(path).select(F.col("value").alias("f")).where("trim(f) <> ''")
    else:
        feature = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    return _typed(feature.select(F.get_json_object("f", "$.properties").alias("properties"), _geojson_wkb(F.get_json_object("f", "$.geometry")).alias("geom_0")), "properties")


def write_geojsonl(rows: DataFrame, path: str, geom: str = "geom_0", max_records: int = 0) -> None:
    """One feature a line, in as many files as there are partitions."""
    attributes = [c for c in rows.columns if c not in (geom, f"{geom}_srid", f"{geom}_srid_proj")]
    line = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}) if attributes else F.lit("{}"), F.lit(',"geometry":'), F.coalesce(_wkb_geojson(geom), F.lit("null")), F.lit("}"))
    rows.select(line.alias("value")).write.option("maxRecordsPerFile", max_records).text(path)


def _shapes(data: bytes) -> list[bytes | None]:
    """Geometries of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        at += 8
        kind = struct.unpack_from("<i", data, at)[0] % 10
        if kind == 1:
            g = geometry.Geometry(1, [np.frombuffer(data, "<f8", 2, at + 4).reshape(1, 2)])
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<ii", data, at + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 44), points]
            xy = np.frombuffer(data, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            lines = [xy[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if kind == 3:
                g = geometry.Geometry(2 if parts == 1 else 5, lines)
            else:
                polygons: list[list] = []
                for ring in lines:
                    turn = float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum())
                    if turn <= 0 or not polygons:  # shells run clockwise
                        polygons.append([ring])
                    else:
                        polygons[-1].append(ring)
                g = geometry.Geometry(3 if len(polygons) == 1 else 6, polygons)
        elif kind == 8:
            n = struct.unpack_from("<i", data, at + 36)[0]
            g = geometry.Geometry(4, [p.reshape(1, 2) for p in np.frombuffer(data, "<f8", 2 * n, at + 40).reshape(-1, 2)])
        else:
            g = None
        out.append(None if g is None else geometry.to_wkb(g))
        at += size
    return out


def _records(data: bytes, encoding: str = "latin-1") -> list[dict]:
    """Rows of a .dbf file."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out = []
    for k in range(n):
        at, row = head + k * size + 1, {}
        for name, kind, width, decimals in fields:
            raw = data[at : at + width].decode(encoding, "replace").strip()
            at += width
            if kind in "NF":
                row[name] = None if not raw or raw[0] == "*" else float(raw) if decimals or "." in raw else int(raw)
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(raw.upper())
            else:
                row[name] = raw or None
        out.append(row)
    return out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of .shp files joined with the .dbf of the same name beside them."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    side = lambda end, name: files.where(F.lower("path").endswith(end)).select(stem.alias("stem"), F.col("content").alias(name))
    pairs = side(".shp", "shp").join(side(".dbf", "dbf"), "stem", "left")

    @F.pandas_udf(_FEATURE)
    def features(shp: pd.Series, dbf: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(shp, dbf, strict=True):
            shapes = _shapes(bytes(a))
            rows = _records(bytes(b)) if b is not None else [{}] * len(shapes)
            out.append([{"properties": json.dumps(r), "geom_0": g} for r, g in zip(rows, shapes, strict=False)])
        return pd.Series(out, dtype=object)

    return _typed(pairs.select(F.inline(features("shp", "dbf"))), "properties")


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of a GeoPackage's layer (the first by default), each file read by one task."""

    @F.pandas_udf(_FEATURE)
    def features(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            db = sqlite3.connect(":memory:")
            db.deserialize(bytes(data))
            name, column = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns" + (" WHERE table_name = ?" if layer else "") + " ORDER BY 1 LIMIT 1", (layer,) if layer else ()).fetchone()
            cursor = db.execute(f'SELECT * FROM "{name}"')
            names = [d[0] for d in cursor.description]
            rows = []
            for values in cursor:
                row = dict(zip(names, values, strict=True))
                blob = row.pop(column)
                envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] if blob else 0
                rows.append({"properties": json.dumps({k: v for k, v in row.items() if not isinstance(v, bytes)}), "geom_0": bytes(blob[8 + envelope :]) if blob else None})
            out.append(rows)
            db.close()
        return pd.Series(out, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path)
    return _typed(files.select(F.inline(features("content"))), "properties")
