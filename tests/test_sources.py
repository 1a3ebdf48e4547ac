"""Formats: what is written is read back, whole and by ranges, with nulls, odd names and filters."""

from __future__ import annotations

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.functions import geometry
from groundweave.raster.codec import Raster, decode, encode
from groundweave.raster.functions import fromcontent
from groundweave.sources import files
from groundweave.sources.formats import listed, register_formats, shard_of
from groundweave.vector import tiles

HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"
SHAPES = {
    "points": ["POINT (1 2)", "POINT (-3.5 4.25)", None, "POINT (100 0)"],
    "lines": ["LINESTRING (0 0, 1 1, 2 0)", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 7))", None, "LINESTRING (50 50, 60 60)"],
    "polygons": [HOLED, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((20 20, 30 20, 30 30, 20 20), (26 24, 28 25, 27 24, 26 24)))", None, "POLYGON ((50 50, 60 50, 60 60, 50 50))"],
}


@pytest.fixture(scope="module")
def spark_(spark):
    register_formats(spark)
    return spark


def table(spark, kind):
    made = [(i, i / 4 if i else None, i % 2 == 0, "é" * i if i else None, "x", bytearray(geometry.to_wkb(geometry.parse(w))) if w else None) for i, w in enumerate(SHAPES[kind])]
    return spark.createDataFrame(made, "id long, half double, even boolean, text string, geom_type string, geom_0 binary").repartition(2)


def shown(rows):
    area = lambda g: None if g is None else (round(geometry.area(g), 6), tuple(np.round(g.bounds(), 6)), len(g.coordinates()))
    return sorted(((r.id, r.half, r.even, r.text, r.geom_type, area(geometry.parse(None if r.geom_0 is None else bytes(r.geom_0)))) for r in rows), key=str)


@pytest.mark.parametrize(
    ("kind", "name", "options"),
    [("polygons", "geojson", {}), ("points", "geojsonl", {"splitBytes": "40"}), ("lines", "geojson", {"multi": "true", "splitBytes": "1000"}), *((kind, "shapefile", {"chunkSize": "1"}) for kind in SHAPES), ("polygons", "gpkg", {"chunkSize": "1"})],
)
def test_vector_round_trip(spark_, tmp_path, kind, name, options):
    rows, path = table(spark_, kind), f"{tmp_path}/out"
    rows.write.format(f"gw_{name}").mode("append").options(**options).save(path)
    back = spark_.read.format(f"gw_{name}").options(**options).load(path)
    assert shown(back.collect()) == shown(rows.collect())
    assert back.columns[-3:] == ["geom_0", "geom_0_srid", "geom_0_srid_proj"]
    near = spark_.read.format(f"gw_{name}").options(**options, bbox="-5,-5,5,5", asWKB="false").load(path)
    assert sorted(r.id for r in near.collect()) == [0, 1] and geometry.parse(near.first().geom_0).parts
    with pytest.raises(Exception, match="isn't empty"):
        rows.write.format(f"gw_{name}").mode("append").options(**options).save(path)
    rows.where("id < 2").coalesce(1).write.format(f"gw_{name}").mode("overwrite").options(**options).save(path)
    assert sorted(r.id for r in spark_.read.format(f"gw_{name}").options(**options).load(path).collect()) == [0, 1]
    assert not [f for f in listed(path) if "_temporary" in f]


def test_empty_and_large_files(spark_, tmp_path):
    none = table(spark_, "points").where("id < 0")
    for name in ("geojson", "geojsonl", "shapefile", "gpkg"):
        none.write.format(f"gw_{name}").mode("append").save(f"{tmp_path}/{name}")
        assert spark_.read.format(f"gw_{name}").load(f"{tmp_path}/{name}").count() == 0
    many = spark_.range(500).select("id", F.lit(1.5).alias("v"), F.unhex(F.lit("0101000000000000000000F03F0000000000000040")).alias("geom_0"))
    many.coalesce(1).write.format("gw_geojsonl").mode("append").option("maxRecordsPerFile", "200").save(f"{tmp_path}/many")
    assert len(listed(f"{tmp_path}/many")) == 3
    for size in ("997", "5000"):
        assert sorted(r.id for r in spark_.read.format("gw_geojsonl").option("splitBytes", size).load(f"{tmp_path}/many").collect()) == list(range(500))


def test_geopackage_is_a_geopackage(spark_, tmp_path):
    table(spark_, "points").coalesce(1).write.format("gw_gpkg").mode("append").option("layerName", "sites").save(f"{tmp_path}/g")
    db = sqlite3.connect(listed(f"{tmp_path}/g")[0])
    assert db.execute("PRAGMA application_id").fetchone() == (0x47504B47,) and db.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    assert db.execute("SELECT table_name, min_x, max_x, srs_id FROM gpkg_contents").fetchall() == [("sites", -3.5, 100.0, 4326)]
    assert files.read_gpkg(spark_, f"{tmp_path}/g").count() == 4


def test_spark_native_readers(spark_, tmp_path):
    rows = table(spark_, "points").withColumn("geom_0_type", F.lit("kept"))
    files.write_geojsonl(rows, f"{tmp_path}/l")
    back = files.read_geojson(spark_, f"{tmp_path}/l", multi=True)
    assert {"geom_0_type", "geom_type"} <= set(back.columns) and back.count() == 4
    table(spark_, "polygons").coalesce(1).write.format("gw_shapefile").mode("append").save(f"{tmp_path}/s")
    assert files.read_shapefile(spark_, f"{tmp_path}/s").count() == 4


def test_rasters(spark_, tmp_path):
    data = [encode(Raster(np.full((1, 8, 8), float(k)), (k * 8.0, 1.0, 0.0, 8.0, 0.0, -1.0), 4326)) for k in range(3)]
    made = spark_.createDataFrame([(f"sub/t{k}", bytearray(d)) for k, d in enumerate(data)], "name string, raster binary").select("name", fromcontent("raster").alias("tile"))
    made.write.format("gw_gtiff").mode("append").option("nameCol", "name").save(f"{tmp_path}/r")
    back = spark_.read.format("gw_raster").load(f"{tmp_path}/r")
    assert sorted(bytes(r.tile.raster) for r in back.collect()) == sorted(data) and back.rdd.getNumPartitions() == 3
    assert spark_.read.format("gw_raster").option("filterRegex", r"t[12]\.tif$").load(f"{tmp_path}/r").count() == 2
    cut = spark_.read.format("gw_raster").option("bbox", "9.5,2,11,5.5").load(f"{tmp_path}/r").collect()
    assert len(cut) == 1 and (decode(bytes(cut[0].tile.raster)).bands.shape, decode(bytes(cut[0].tile.raster)).gt[0]) == ((1, 4, 2), 9.0)
    parts = spark_.read.format("gw_raster").option("sizeInMB", "0.0002").load(f"{tmp_path}/r").collect()
    assert len(parts) > 3 and sum(decode(bytes(p.tile.raster)).bands.size for p in parts) == 3 * 64
    assert spark_.read.format("gw_raster").option("filterRegex", "nothing").load(f"{tmp_path}/r").count() == 0
    with pytest.raises(Exception, match="name one file"):
        made.withColumn("name", F.lit("same")).write.format("gw_raster").mode("overwrite").option("nameCol", "name").save(f"{tmp_path}/q")


def test_tile_archives(spark_, tmp_path):
    every = [(z, x, y) for z in range(4) for x in range(2**z) for y in range(2**z)]
    assert [tiles.hilbert_tile(tiles.hilbert_id(*t)) for t in every] == every
    made = spark_.createDataFrame([(*t, bytearray(f"{t}".encode())) for t in every], "z int, x int, y int, bytes binary").coalesce(1)
    made.write.format("gw_pmtiles").mode("append").option("shardZoom", "2").option("metadata", '{"name": "n"}').save(f"{tmp_path}/p")
    assert len(listed(f"{tmp_path}/p", ".pmtiles")) == 1 + 16 and shard_of(3, 5, 2, 2) == "2-2-1"
    back = spark_.read.format("gw_pmtiles").load(f"{tmp_path}/p")
    assert sorted((r.z, r.x, r.y, bytes(r.bytes).decode()) for r in back.collect()) == sorted((*t, f"{t}") for t in every)
    some = spark_.read.format("gw_pmtiles").option("minZoom", "2").option("maxZoom", "2").option("bbox", "1,1,10,10").load(f"{tmp_path}/p").collect()
    assert [(r.z, r.x, r.y) for r in some] == [(2, 2, 1)]
    made.write.format("gw_pmtiles").mode("overwrite").option("shardZoom", "0").option("fileName", "all").save(f"{tmp_path}/p")
    assert [f.rsplit("/", 1)[1] for f in listed(f"{tmp_path}/p")] == ["all.pmtiles"]
    assert tiles.pmtiles_info(listed(f"{tmp_path}/p")[0])["addressed"] == len(every)
