"""Codecs and kernels on closed-form cases."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave.functions import bng, geometry, quadbin, wkb
from groundweave.raster import codec, crs, kernels
from groundweave.raster.codec import Raster, decode, encode


def test_wkb_is_exact(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-9, 123456.789, -179.99999, 2.0**40, 3e-300]
    got = spark.createDataFrame([(v, -v) for v in values], "x double, y double").select(wkb.point_wkb(F.col("x"), F.col("y")).alias("w")).collect()
    assert [struct.unpack(">dd", bytes(r.w)[5:]) for r in got] == [(v, -v) for v in values]


def test_geometry_round_trip():
    for text in ("POINT (1 2)", "LINESTRING (0 0, 1 1, 2 0)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "SRID=4326;POINT (3 4)"):
        g = geometry.parse(text)
        again = geometry.parse(geometry.to_wkb(g, srid=True))
        assert again.kind == g.kind and np.array_equal(again.coordinates(), g.coordinates()) and again.srid == g.srid
    assert geometry.parse(None) is None
    with pytest.raises(ValueError):
        geometry.parse("CIRCLE (1)")


def test_overlay():
    a = geometry.parse("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    b = geometry.parse("POLYGON ((3 3, 6 3, 6 6, 3 6, 3 3))")
    assert geometry.area(a) == 15 and geometry.area(geometry.intersection([a, b])) == pytest.approx(1) and geometry.area(geometry.union([a, b])) == pytest.approx(23)
    c = geometry.parse("POLYGON ((0 0, 10 0, 0 10, 0 0))")
    assert geometry.area(geometry.clip_box(c, 0, 0, 5, 10)) == pytest.approx(37.5)
    assert geometry.area(geometry.intersection([c, geometry.box(0, 0, 5, 10)])) == pytest.approx(37.5)


def test_quadbin_vectors(spark):
    row = spark.range(1).select(quadbin.pointascell(F.lit(180.0), F.lit(85.05112878), F.lit(14)).alias("c"), quadbin.from_tile(0, 0, 0).alias("z")).select("z", *(v.alias(n) for v, n in zip(quadbin.tile("c"), "rxy", strict=True))).first()
    assert (row.r, row.x, row.y) == (14, 16383, 0) and row.z >> 62 == 1 and row.z >> 59 & 7 == 1
    with pytest.raises(Exception, match="resolution"):
        spark.range(1).select(quadbin.pointascell(F.lit(0.0), F.lit(0.0), F.lit(27))).collect()


def test_bng_vectors(spark):
    assert spark.range(1).select(bng.eastnorthasbng(F.lit(530000), F.lit(180000), "1km")).first()[0] == "TQ3080"
    for bad in (1000, 7, "nope", True):
        with pytest.raises(ValueError):
            bng.resolution_index(bad)
    cells = [(r, spark.range(1).select(bng.eastnorthasbng(F.lit(451234), F.lit(956789), r)).first()[0]) for r in bng.RESOLUTIONS.values()]
    table = spark.createDataFrame(cells, "r int, c string")
    for row in table.select("r", "c", *(v.alias(n) for v, n in zip(bng.parts("c"), ("x", "y", "edge", "res"), strict=True))).collect():
        assert row.res == row.r and row.edge == bng.edge_of(row.r)
        if row.r != -1:
            assert row.x == 451234 // row.edge * row.edge and row.y == 956789 // row.edge * row.edge


def test_geotiff_round_trip():
    rng = np.random.default_rng(0)
    for kind in ("u1", "i2", "u2", "i4", "f4", "f8"):
        r = Raster((rng.random((2, 5, 7)) * 200).astype(kind), (10.0, 0.5, 0.0, 50.0, 0.0, -0.5), 32633, -9999.0, {"a": "b"})
        again = decode(encode(r))
        assert np.array_equal(again.bands, r.bands) and again.gt == r.gt and again.srid == r.srid and again.nodata == r.nodata and again.tags == r.tags and encode(again) == encode(r)
    assert not kernels.tryopen(b"nothing")


def test_terrain():
    flat = Raster(np.full((1, 5, 5), 100.0), nodata=-9999.0)
    ramp = flat.like(np.tile(np.arange(5.0), (5, 1)))
    assert kernels.slope(flat).bands[0, 2, 2] == 0 and kernels.slope(flat).bands[0, 0, 0] == -9999
    assert kernels.slope(ramp).bands[0, 2, 2] == pytest.approx(45)
    assert kernels.aspect(flat).bands[0, 2, 2] == -9999 and kernels.aspect(flat, False, True).bands[0, 2, 2] == 0
    assert np.unique(kernels.aspect(ramp).bands[0, 1:-1, 1:-1]).tolist() == [270.0]


def test_crs_round_trip():
    lon, lat = np.array([14.0, 15.5, 16.2]), np.array([48.0, -33.0, 60.1])
    for srid in (3857, 32633, 32733):
        x, y = crs.from_lonlat(lon, lat, srid)
        assert np.allclose(crs.to_lonlat(x, y, srid), (lon, lat), atol=1e-7)
    e, n = crs.from_lonlat(np.array([15.0]), np.array([0.0]), 32633)
    assert abs(e[0] - 500000) < 1e-6 and abs(n[0]) < 1e-6


def test_shapes_and_distances():
    band = np.array([[1, 1, 2], [1, 3, 2], [1, 1, 2]], float)
    r = Raster(band[None], (0.0, 1.0, 0.0, 3.0, 0.0, -1.0), nodata=-9999.0)
    shapes = kernels.polygonize(r)
    assert sorted((s["value"], geometry.area(geometry.parse(s["geom_wkb"]))) for s in shapes) == [(1.0, 5.0), (2.0, 3.0), (3.0, 1.0)]
    d = kernels.proximity(r, [3]).bands[0]
    assert d[1, 1] == 0 and d[0, 0] == pytest.approx(2**0.5)
    with pytest.raises(ValueError):
        kernels._algebra("__import__('os')", {})


@pytest.mark.parametrize("compression", ["DEFLATE", "NONE"])
@pytest.mark.parametrize("dtype", ["f4", "u1", "i2"])
def test_tiled_files_hold_their_overviews(compression, dtype):
    rng = np.random.default_rng(2)
    r = Raster(rng.integers(0, 100, (2, 150, 70)).astype(dtype), (5.0, 0.5, 0.0, 9.0, 0.0, -0.5), 4326, 7.0, {"a": "b"})
    data = encode(kernels.cog_convert(r, compression, 16))
    got = decode(data, reduced=True)
    assert (got.bands == r.bands).all() and got.bands.dtype == r.bands.dtype and (got.gt, got.srid, got.nodata, got.tags) == (r.gt, 4326, 7.0, {"a": "b"})
    assert [o.shape for o in got.overviews] == [(2, 75, 35), (2, 38, 18), (2, 19, 9), (2, 10, 5)] and got.block == 16 and got.compression == compression
    block = r.bands[1, 4:8, 8:12].astype(float)
    want = block[block != 7].mean()
    assert got.overviews[1][1, 1, 2] == (np.dtype(dtype).type(want) if dtype == "f4" else np.floor(want + 0.5))
    # Directories come first, in the order of images; then the pixels, the smallest image's before the others'.
    at, seen, first = struct.unpack_from("<I", data, 4)[0], [], []
    while at:
        tags, following = codec._directory(data, "<", at)
        seen.append(at)
        first.append(min(tags[324]))
        at = following
    assert seen == sorted(seen) and first == sorted(first, reverse=True) and seen[-1] < min(first)
    plain = kernels.buildoverviews(r, [2, 4], "nearest")
    back = decode(encode(plain), reduced=True)
    assert (back.overviews[0] == r.bands[:, ::2, ::2]).all() and back.block == 0 and not decode(encode(plain)).overviews
    for bad in (lambda: kernels.cog_convert(r, "JPEG"), lambda: kernels.cog_convert(r, "NONE", 20), lambda: kernels.buildoverviews(r, [1])):
        with pytest.raises(ValueError):
            bad()


def test_proximity_rounds_halves_away():
    r = Raster(np.array([[[0.5, 0.2, 0.0, -0.5, 0.4]]]))
    assert kernels.proximity(r, None, "PIXEL").bands[0, 0].tolist() == [0.0, 1.0, 1.0, 0.0, 1.0]
