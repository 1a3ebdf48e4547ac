"""Raster queries: tiles built from the pixel relation of ``lineitem``, put through each function, and read as pixels again.

The SQL computes the same from the relation by neighbour joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.wkb import box_wkb, point_wkb
from ..operators import pixels as P
from ..raster.functions import combineavg_agg, derivedband_agg, frombands_agg, from_pixels, fromcontent, gridfrompoints_agg, merge_agg, overview, rasterize_agg, rst, to_pixels
from .derive import PIXELS_SQL, pixels

GT = (10.0, 0.5, 0.0, 50.0, 0.0, -0.5)
_PLAIN = (0.0, 10.0, 0.0, 640.0, 0.0, -10.0)
_BANDS_SQL = f'SELECT tile_id, b::INT AS band, "row", col, value * b + b * ((col + b) % 3 + 1) * 100 AS value FROM ({PIXELS_SQL}), range(1, 4) r(b)'


def _bands(spark, sf_dir):
    b = F.col("band")
    made = pixels(spark, sf_dir).drop("band").withColumn("band", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return made.select("tile_id", "band", "row", "col", (F.col("value") * b + b * ((F.col("col") + b) % 3 + 1) * 100).alias("value"))


def _tiles(spark, sf_dir, bands=False, gt=GT, srid=4326):
    return from_pixels(_bands(spark, sf_dir) if bands else pixels(spark, sf_dir), 64, 64, gt, srid)


def _shown(tiles, digits=6):
    found = to_pixels(tiles, "tile", "tile_id")
    return found.select("tile_id", "band", "row", "col", F.round("value", digits).alias("value"))


def _through(name, *args, bands=False, gt=_PLAIN, srid=0, digits=6):
    def query(spark, sf_dir):
        t = _tiles(spark, sf_dir, bands, gt, srid)
        return _shown(t.select("tile_id", rst(name, "tile", *args).alias("tile")), digits)

    return query


def _accessor(name, *args, bands=True, kind=None):
    def query(spark, sf_dir):
        value = rst(name, "tile", *args)
        return _tiles(spark, sf_dir, bands).select("tile_id", (value if kind is None else kind(value)).alias("value"))

    return query


def _by_band(name):
    def query(spark, sf_dir):
        found = _tiles(spark, sf_dir, True).select("tile_id", F.posexplode(rst(name, "tile")).alias("pos", "value"))
        return found.select("tile_id", (F.col("pos") + 1).alias("band"), F.round("value", 6).alias("value"))

    return query


def _native(f, digits=6):
    def query(spark, sf_dir):
        found = f(pixels(spark, sf_dir))
        return found.select("tile_id", "band", "row", "col", F.round("value", digits).alias("value"))

    return query


def _pixels_of(tiles):
    """Pixels of a query's array of tiles: how many tiles, and sums over them."""
    one = tiles.select("tile_id", F.posexplode("parts").alias("part", "tile"))
    return one.select("tile_id", "part", F.struct("tile.*").alias("tile"))


def _parts(name, *args, bands=False):
    def query(spark, sf_dir):
        found = _pixels_of(_tiles(spark, sf_dir, bands).select("tile_id", rst(name, "tile", *args).alias("parts")))
        size = found.select("tile_id", "part", rst("width", "tile").alias("width"), rst("height", "tile").alias("height"), rst("numbands", "tile").alias("bands"))
        return size

    return query


def _cog(spark, sf_dir):
    """Pixels of a tiled file and of its first overview."""
    made = _tiles(spark, sf_dir).select("tile_id", rst("cog_convert", "tile", "DEFLATE", 16).alias("tile"))
    first = made.select("tile_id", overview("tile", 1).alias("tile"))
    return _shown(made).withColumn("factor", F.lit(1)).unionByName(_shown(first).withColumn("factor", F.lit(2)))


def _histogram(spark, sf_dir):
    found = _tiles(spark, sf_dir).select("tile_id", F.element_at(rst("histogram", "tile", 8, 0.0, 80000.0), "band_1").alias("h"))
    return found.select("tile_id", F.posexplode("h").alias("bucket", "n"))


def _coord(name, x, y):
    return lambda spark, sf_dir: _tiles(spark, sf_dir).select("tile_id", rst(name, "tile", x, y).alias("v")).select("tile_id", "v.*")


def _sample(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("p", point_wkb(F.lit(10.0) + (F.col("tile_id") + 0.5) * 0.5, F.lit(45.25)))
    return t.select("tile_id", F.round(F.element_at(rst("sample", "tile", F.col("p")), 1), 2).alias("value"))


def _clip(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("g", box_wkb(F.lit(15.0), F.lit(30.0), F.lit(25.0), F.lit(40.0)))
    return _shown(t.select("tile_id", rst("clip", "tile", F.col("g"), F.lit(False)).alias("tile")), 2).drop("row", "col")


def _quadbin(measure):
    def query(spark, sf_dir):
        found = _tiles(spark, sf_dir).select("tile_id", F.element_at(rst(f"quadbin_rastertogrid{measure}", "tile", 5), 1).alias("cells")).select("tile_id", F.inline("cells"))
        return found.select("tile_id", F.col("cellID").alias("cell"), F.round("measure", 8).alias("measure"))

    return query


def _quadbin_native(spark, sf_dir):
    return P.to_quadbin(pixels(spark, sf_dir), GT, 5, "avg").select("tile_id", "cell", F.round("avg", 8).alias("measure"))


def _agg(f):
    def query(spark, sf_dir):
        whole = _tiles(spark, sf_dir).groupBy(F.lit(0).cast("long").alias("tile_id")).agg(f("tile").alias("tile"))
        return _shown(whole)

    return query


def _frombands_agg(spark, sf_dir):
    whole = _tiles(spark, sf_dir).groupBy(F.lit(0).cast("long").alias("tile_id")).agg(frombands_agg("tile", "tile_id").alias("tile"))
    return _shown(whole, 2)


def _array(name, *args):
    def query(spark, sf_dir):
        whole = _tiles(spark, sf_dir).groupBy(F.lit(0).cast("long").alias("tile_id")).agg(F.array_sort(F.collect_list(F.struct("tile_id", F.col("tile").getField("raster").alias("raster")))).alias("xs"))
        tiles = F.transform("xs", lambda x: F.struct(F.lit(0).cast("long").alias("cellid"), x["raster"].alias("raster"), F.create_map(F.lit("driver"), F.lit("GTiff")).alias("metadata")))
        return _shown(whole.select("tile_id", tiles.alias("tiles")).select("tile_id", rst(name, "tiles", *args).alias("tile")))

    return query


def _mapalgebra(spark, sf_dir):
    """Each tile with the next one by id, the last with the first."""
    t = _tiles(spark, sf_dir)
    row = Window.orderBy("tile_id")  # sixteen tiles at most
    after = t.select("tile_id").withColumn("next", F.coalesce(F.lead("tile_id").over(row), F.first("tile_id").over(row)))
    other = t.select(F.col("tile_id").alias("next"), F.col("tile").alias("other"))
    pairs = t.join(after, "tile_id").join(other, "next").select("tile_id", F.array("tile", "other").alias("tiles"))
    return _shown(pairs.select("tile_id", rst("mapalgebra", "tiles", "(A + B) / 2").alias("tile")))


def _rasterize(spark, sf_dir):
    zone = pixels(spark, sf_dir).select("tile_id").distinct().withColumn("g", box_wkb(F.col("tile_id") * 1.0, F.lit(0.0), F.col("tile_id") + 10.0, F.lit(5.0)))
    made = zone.select("tile_id", rst("rasterize", "g", F.col("tile_id") + 1.0, 0.0, 0.0, 32.0, 32.0, 32, 32, 0).alias("tile"))
    return _shown(made)


def _rasterize_agg(spark, sf_dir):
    zone = pixels(spark, sf_dir).select("tile_id").distinct().withColumn("g", box_wkb(F.col("tile_id") * 2.0, F.lit(0.0), F.col("tile_id") * 2 + 2.0, F.lit(5.0)))
    return _shown(zone.groupBy(F.lit(0).cast("long").alias("id")).agg(rasterize_agg("g", F.col("tile_id") * 1.0, 0.0, 0.0, 32.0, 32.0, 32, 32, 0).alias("tile")).withColumnRenamed("id", "tile_id"))


def _idw(spark, sf_dir):
    points = pixels(spark, sf_dir).withColumn("g", point_wkb(F.col("col") + 0.5, F.col("row") + 0.5))
    made = points.groupBy("tile_id").agg(gridfrompoints_agg("g", "value", 0.0, 0.0, 64.0, 64.0, 16, 16, 0).alias("tile"))
    return _shown(made, 3)


def _polygonize(spark, sf_dir):
    coarse = _bands(spark, sf_dir).where("band = 1").withColumn("value", F.floor(F.col("value") / 20000).cast("double"))
    shapes = from_pixels(coarse, 64, 64, (0.0, 1.0, 0.0, 16.0, 0.0, -1.0)).select("tile_id", F.inline(rst("polygonize", "tile")))
    return shapes.groupBy("tile_id", "value").agg(F.round(F.sum(cells.area_of("geom_wkb")), 6).alias("area"))


def _retile_native(spark, sf_dir):
    return P.retile(pixels(spark, sf_dir), 16, 16).groupBy("tile_id", "window_x", "window_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


KERNEL = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]


def queries() -> dict:
    found = {f"rst_{n}": _by_band(n) for n in ("avg", "min", "max", "median", "pixelcount", "getnodata")}
    found |= {f"rst_{n}": _accessor(n) for n in ("width", "height", "numbands", "srid", "scalex", "scaley", "skewx", "skewy", "upperleftx", "upperlefty", "rotation", "pixelwidth", "pixelheight", "format", "isempty", "tryopen", "memsize", "summary")}
    found["rst_type"] = _accessor("type", kind=lambda v: F.array_join(v, ","))
    keys = ("upperLeftX", "scaleX", "skewX", "upperLeftY", "skewY", "scaleY")
    found["rst_georeference"] = lambda spark, sf_dir: _tiles(spark, sf_dir).select("tile_id", rst("georeference", "tile").alias("m")).select("tile_id", *(F.col("m").getItem(k).alias(k) for k in keys))
    found["rst_metadata"] = lambda spark, sf_dir: _tiles(spark, sf_dir, True).select("tile_id", rst("metadata", "tile").alias("m")).select("tile_id", *(F.col("m").getItem(k).alias(k) for k in ("driver", "width", "height", "count", "dtype", "crs", "nodata")))
    found["rst_bandmetadata"] = lambda spark, sf_dir: _tiles(spark, sf_dir, True).select("tile_id", rst("bandmetadata", "tile", 2).alias("m")).select("tile_id", F.col("m").getItem("band").alias("band"))
    found["rst_subdatasets"] = _accessor("subdatasets", kind=F.size)
    found["rst_getsubdataset"] = lambda spark, sf_dir: _tiles(spark, sf_dir).select("tile_id", rst("getsubdataset", "tile", "a").isNull().alias("value"))
    found["rst_boundingbox"] = lambda spark, sf_dir: _tiles(spark, sf_dir).select("tile_id", cells.bounds_of(rst("boundingbox", "tile")).alias("b")).select("tile_id", "b.*")
    found |= {f"rst_{n}": _through(n) for n in ("slope", "aspect", "hillshade", "tpi", "roughness", "fillnodata", "initnodata", "proximity")}
    found["rst_tri"] = _through("tri", digits=3)
    found |= {"rst_filter": _through("filter", 3, "avg"), "rst_filter_median": _through("filter", 3, "median"), "rst_filter_mode": _through("filter", 3, "mode"), "rst_filter_max": _through("filter", 5, "max"), "rst_convolve": _through("convolve", KERNEL)}
    found |= {"rst_threshold": _through("threshold", ">", 40000.0), "rst_updatetype": _through("updatetype", "Int32"), "rst_setsrid": lambda s, d: _tiles(s, d).select("tile_id", rst("srid", rst("setsrid", "tile", 3857)).alias("value"))}
    found |= {"rst_band": _through("band", 2, bands=True), "rst_ndvi": _through("ndvi", 1, 2, bands=True), "rst_evi": _through("evi", 1, 2, 3, bands=True), "rst_savi": _through("savi", 1, 2, bands=True), "rst_ndwi": _through("ndwi", 1, 2, bands=True), "rst_nbr": _through("nbr", 1, 2, bands=True), "rst_index": _through("index", "gndvi", {"green": 1, "nir": 2}, bands=True)}
    found |= {"rst_resample": _through("resample", 0.5, "nearest"), "rst_resample_to_size": _through("resample_to_size", 32, 32, "nearest"), "rst_resample_to_res": _through("resample_to_res", 20.0, 20.0, "nearest")}
    found["rst_buildoverviews"] = lambda s, d: _shown(_tiles(s, d).select("tile_id", overview(rst("buildoverviews", "tile", [2, 4]), 2).alias("tile")))
    found["rst_cog_convert"] = _cog
    found |= {"rst_transform": _through("transform", 3857, gt=GT, srid=4326), "rst_to_webmercator": _through("to_webmercator", "nearest", gt=GT, srid=4326)}
    found |= {"rst_retile": _parts("retile", 24, 24), "rst_tooverlappingtiles": _parts("tooverlappingtiles", 32, 32, 25.0), "rst_maketiles": _parts("maketiles", 0.01), "rst_separatebands": _parts("separatebands", bands=True)}
    found |= {"rst_rastertoworldcoord": _coord("rastertoworldcoord", 3, 5), "rst_worldtorastercoord": _coord("worldtorastercoord", 12.3, 44.4)}
    found |= {f"rst_{n}": _accessor(n, *a) for n, a in {"rastertoworldcoordx": (3, 5), "rastertoworldcoordy": (3, 5), "worldtorastercoordx": (12.3, 44.4), "worldtorastercoordy": (12.3, 44.4)}.items()}
    found |= {"rst_histogram": _histogram, "rst_sample": _sample, "rst_clip": _clip, "rst_polygonize": _polygonize, "rst_rasterize": _rasterize, "rst_rasterize_agg": _rasterize_agg, "rst_gridfrompoints_agg": _idw}
    found |= {f"rst_quadbin_rastertogrid{m}": _quadbin(m) for m in ("avg", "count", "max", "min", "median")}
    found |= {"rst_combineavg_agg": _agg(combineavg_agg), "rst_merge_agg": _agg(merge_agg), "rst_frombands_agg": _frombands_agg, "rst_combineavg": _array("combineavg"), "rst_merge": _array("merge"), "rst_frombands": _array("frombands"), "rst_mapalgebra": _mapalgebra}
    source = "def top(bands):\n    return np.fmax.reduce(bands)\n"
    found |= {"rst_derivedband": _array("derivedband", source, "top"), "rst_derivedband_agg": _agg(lambda t: derivedband_agg(t, source, "top"))}
    found["rst_fromcontent"] = lambda s, d: _shown(_tiles(s, d).select("tile_id", fromcontent("tile.raster", "GTiff").alias("tile")))
    found["rst_asformat"] = lambda s, d: _shown(_tiles(s, d).select("tile_id", rst("asformat", "tile", "GTiff").alias("tile")))
    found["rst_contour"] = lambda s, d: _tiles(s, d, gt=_PLAIN).select("tile_id", F.inline(rst("contour", rst("fillnodata", "tile"), [30000.0, 50000.0]))).groupBy("tile_id", "value").agg(F.count(F.lit(1)).alias("n_lines"))
    found["rst_viewshed"] = lambda s, d: _shown(_tiles(s, d, gt=_PLAIN).select("tile_id", rst("viewshed", rst("fillnodata", "tile"), point_wkb(F.lit(325.0), F.lit(325.0)), 100.0).alias("tile"))).groupBy("tile_id", "value").agg(F.count(F.lit(1)).alias("n"))
    found["rst_color_relief"] = lambda s, d: _shown(_tiles(s, d, gt=_PLAIN).select("tile_id", rst("color_relief", "tile", "0 0 0 0\n100000 255 255 255").alias("tile")))
    found["rst_tilexyz"] = lambda s, d: _tiles(s, d).select("tile_id", F.substring(rst("tilexyz", "tile", 4, 8, 5), 1, 8).alias("head"))
    found["rst_xyzpyramid"] = lambda s, d: _tiles(s, d).select("tile_id", F.inline(rst("xyzpyramid", "tile", 2, 4, "PNG", 64))).select("tile_id", "z", "x", "y")
    found |= {"pixels_slope": _native(lambda p: P.slope(p, 10.0, 10.0)), "pixels_aspect": _native(lambda p: P.aspect(p, 10.0, 10.0)), "pixels_tri": _native(P.tri, 3), "pixels_tpi": _native(P.tpi), "pixels_roughness": _native(P.roughness), "pixels_focal": _native(lambda p: P.focal(p, 3, "avg", 64, 64)), "pixels_convolve": _native(lambda p: P.convolve(p, KERNEL))}
    found["pixels_ndvi"] = lambda s, d: P.map_algebra(_bands(s, d), "(nir - red) / (nir + red)", {"red": 1, "nir": 2}).select("tile_id", "band", "row", "col", F.round("value", 6).alias("value"))
    found |= {"pixels_quadbin": _quadbin_native, "pixels_retile": _retile_native}
    found["pixels_statistics"] = lambda s, d: P.statistics(_bands(s, d)).select("tile_id", "band", *(F.round(c, 6).alias(c) for c in ("avg", "min", "max", "median")), "pixelcount")
    return found


def oracle_sql() -> dict[str, str]:
    p, b = f"WITH p AS ({PIXELS_SQL})", f"WITH p AS ({_BANDS_SQL})"
    const = lambda v: f"{p} SELECT DISTINCT tile_id, {v} AS value FROM p"
    near = f'{p}, n AS (SELECT c.tile_id, c.band, c."row", c.col, c.value AS v, q."row" - c."row" AS dr, q.col - c.col AS dc, q.value AS w FROM p c JOIN p q ON q.tile_id = c.tile_id AND q."row" BETWEEN c."row" - {{k}} AND c."row" + {{k}} AND q.col BETWEEN c.col - {{k}} AND c.col + {{k}})'
    near1 = near.format(k=1)
    keys = 'tile_id, band, "row", col'
    weighted = lambda w: " + ".join(f"{v} * coalesce(max(w) FILTER (WHERE dr = {i} AND dc = {j}), 0)" for (i, j), v in w.items())
    gradient = f"{near1}, g AS (SELECT {keys}, ({weighted(P._GX)}) / 80.0 AS gx, ({weighted(P._GY)}) / 80.0 AS gy FROM n GROUP BY {keys} HAVING count(*) = 9)"
    slope = f"{gradient} SELECT {keys}, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS value FROM g"
    aspect = f"{gradient}, a AS (SELECT *, 90 - degrees(atan2(gy, -gx)) AS d FROM g WHERE gx <> 0 OR gy <> 0) SELECT {keys}, round(d - 360 * floor(d / 360), 6) AS value FROM a"
    tri = f"{near1} SELECT {keys}, round(sqrt(sum((w - v) * (w - v))), 3) AS value FROM n GROUP BY {keys} HAVING count(*) = 9"
    tpi = f"{near1} SELECT {keys}, round(max(v) - (sum(w) - max(v)) / 8, 6) AS value FROM n GROUP BY {keys} HAVING count(*) = 9"
    rough = f"{near1} SELECT {keys}, round(max(w) - min(w), 6) AS value FROM n GROUP BY {keys} HAVING count(*) = 9"
    sent = lambda k: f'{p}, n AS (SELECT tile_id, band, ("row" - dr)::INT AS "row", (col - dc)::INT AS col, dr, dc, value AS w FROM p, range(-{k}, {k} + 1) a(dr), range(-{k}, {k} + 1) b(dc) WHERE "row" - dr BETWEEN 0 AND 63 AND col - dc BETWEEN 0 AND 63)'
    mean = f"{sent(1)} SELECT {keys}, round(avg(w), 6) AS value FROM n GROUP BY {keys}"
    wide = f'{b}, w AS (SELECT tile_id, "row", col, max(value) FILTER (WHERE band = 1) AS b1, max(value) FILTER (WHERE band = 2) AS b2, max(value) FILTER (WHERE band = 3) AS b3 FROM p GROUP BY ALL)'
    index = lambda f: f'{wide} SELECT tile_id, 1::INT AS band, "row", col, round({f}, 6) AS value FROM w'
    half = f'{p} SELECT tile_id, band, ("row" // 2)::INT AS "row", (col // 2)::INT AS col, round(value, 6) AS value FROM p WHERE "row" % 2 = 1 AND col % 2 = 1'
    stats = lambda f, kind="": f"{b} SELECT tile_id, band, round({f}, 6){kind} AS value FROM p GROUP BY tile_id, band"
    cell = 'SELECT *, floor((10 + 0.5 * (col + 0.5) + 180) / 360 * 32)::BIGINT << 21 AS wx, floor((0.5 - ln((1 + sin(radians(50 - 0.5 * ("row" + 0.5)))) / (1 - sin(radians(50 - 0.5 * ("row" + 0.5))))) / (4 * pi())) * 32)::BIGINT << 21 AS wy FROM p'
    from .grid_queries import _spread_sql

    grid = f"{p}, c AS ({cell}), k AS (SELECT *, {0x4800000000000000} | (5::BIGINT << 52) | {_spread_sql('wx')} | ({_spread_sql('wy')} << 1) | {((1 << 52) - 1) >> 10} AS cell FROM c)"
    measure = lambda f: f"{grid} SELECT tile_id, cell, round({f}, 8)::DOUBLE AS measure FROM k GROUP BY tile_id, cell"
    whole = lambda f, where="TRUE": f'{p} SELECT 0::BIGINT AS tile_id, band, "row", col, round({f}, 6) AS value FROM p WHERE {where} GROUP BY band, "row", col'
    parts = lambda step, size: f"{p}, t AS (SELECT DISTINCT tile_id FROM p), x AS (SELECT i, i * {step} AS at FROM range(0, {-(-64 // step)}) r(i)) SELECT tile_id, (b.i * {-(-64 // step)} + a.i)::INT AS part, least({size}, 64 - a.at)::INT AS width, least({size}, 64 - b.at)::INT AS height, 1::INT AS bands FROM t, x a, x b"
    found = {
        "rst_avg": stats("avg(value)"), "rst_min": stats("min(value)"), "rst_max": stats("max(value)"), "rst_median": stats("median(value)"), "rst_pixelcount": f"{b} SELECT tile_id, band, count(*) AS value FROM p GROUP BY tile_id, band",
        "rst_getnodata": f"{b} SELECT DISTINCT tile_id, band, -9999.0::DOUBLE AS value FROM p",
        **{f"rst_{n}": const(v) for n, v in {"width": "64::INT", "height": "64::INT", "numbands": "3::INT", "srid": "4326::INT", "scalex": "0.5::DOUBLE", "scaley": "-0.5::DOUBLE", "skewx": "0.0::DOUBLE", "skewy": "0.0::DOUBLE", "upperleftx": "10.0::DOUBLE", "upperlefty": "50.0::DOUBLE", "rotation": "0.0::DOUBLE", "pixelwidth": "0.5::DOUBLE", "pixelheight": "0.5::DOUBLE", "format": "'GTiff'", "isempty": "FALSE", "tryopen": "TRUE", "type": "'Float64,Float64,Float64'", "subdatasets": "0::INT", "getsubdataset": "TRUE", "setsrid": "3857::INT", "fromcontent": "64::INT", "asformat": "64::INT", "rastertoworldcoordx": "11.75::DOUBLE", "rastertoworldcoordy": "47.25::DOUBLE", "worldtorastercoordx": "4::INT", "worldtorastercoordy": "11::INT"}.items()},
        "rst_boundingbox": f"{p} SELECT DISTINCT tile_id, 10.0::DOUBLE AS xmin, 18.0::DOUBLE AS ymin, 42.0::DOUBLE AS xmax, 50.0::DOUBLE AS ymax FROM p",
        "rst_georeference": f'{p} SELECT DISTINCT tile_id, 10.0::DOUBLE AS "upperLeftX", 0.5::DOUBLE AS "scaleX", 0.0::DOUBLE AS "skewX", 50.0::DOUBLE AS "upperLeftY", 0.0::DOUBLE AS "skewY", -0.5::DOUBLE AS "scaleY" FROM p',
        "rst_metadata": f"{p} SELECT DISTINCT tile_id, 'GTiff' AS driver, '64' AS width, '64' AS height, '3' AS count, 'Float64' AS dtype, 'EPSG:4326' AS crs, '-9999.0' AS nodata FROM p",
        "rst_bandmetadata": f"{p} SELECT DISTINCT tile_id, '2' AS band FROM p",
        "rst_rastertoworldcoord": f"{p} SELECT DISTINCT tile_id, 11.75::DOUBLE AS x, 47.25::DOUBLE AS y FROM p", "rst_worldtorastercoord": f"{p} SELECT DISTINCT tile_id, 4::INT AS x, 11::INT AS y FROM p",
        **dict.fromkeys(("rst_slope", "pixels_slope"), slope), **dict.fromkeys(("rst_aspect", "pixels_aspect"), aspect), **dict.fromkeys(("rst_tri", "pixels_tri"), tri), **dict.fromkeys(("rst_tpi", "pixels_tpi"), tpi), **dict.fromkeys(("rst_roughness", "pixels_roughness"), rough),
        **dict.fromkeys(("rst_filter", "pixels_focal"), mean), "rst_filter_median": f"{sent(1)} SELECT {keys}, round(median(w), 6) AS value FROM n GROUP BY {keys}", "rst_filter_max": f"{sent(2)} SELECT {keys}, round(max(w), 6) AS value FROM n GROUP BY {keys}",
        "rst_convolve": f"{sent(1)}, t AS (SELECT DISTINCT tile_id FROM p), c AS (SELECT {keys}, {weighted({(i - 1, j - 1): v for i, r in enumerate(KERNEL) for j, v in enumerate(r) if v})} AS value FROM n GROUP BY {keys}) SELECT t.tile_id, 1::INT AS band, r::INT AS \"row\", q::INT AS col, round(coalesce(c.value, 0), 6) AS value FROM t CROSS JOIN range(0, 64) a(r) CROSS JOIN range(0, 64) b(q) LEFT JOIN c ON c.tile_id = t.tile_id AND c.\"row\" = r AND c.col = q",
        "pixels_convolve": f"{near1} SELECT {keys}, round({weighted({(i - 1, j - 1): v for i, r in enumerate(KERNEL) for j, v in enumerate(r) if v})}, 6) AS value FROM n GROUP BY {keys}",
        "rst_initnodata": f"{p} SELECT {keys}, round(value, 6) AS value FROM p",
        "rst_buildoverviews": f'{p} SELECT tile_id, band, "row" // 4 AS "row", col // 4 AS col, round(avg(value), 6) AS value FROM p GROUP BY ALL',
        "rst_cog_convert": f'{p} SELECT 1 AS factor, {keys}, round(value, 6) AS value FROM p UNION ALL SELECT 2, tile_id, band, "row" // 2, col // 2, round(avg(value), 6) FROM p GROUP BY ALL',
        "rst_threshold": f"{p} SELECT {keys}, value FROM p WHERE value > 40000", "rst_updatetype": f"{p} SELECT {keys}, round_even(value, 0) AS value FROM p",
        "rst_band": f'{b} SELECT tile_id, 1::INT AS band, "row", col, round(value, 6) AS value FROM p WHERE band = 2',
        **dict.fromkeys(("rst_ndvi", "pixels_ndvi"), index("(b2 - b1) / (b2 + b1)")), "rst_evi": index("2.5 * (b2 - b1) / (b2 + 6 * b1 - 7.5 * b3 + 1)"), "rst_savi": index("(b2 - b1) / (b2 + b1 + 0.5) * 1.5"), "rst_ndwi": index("(b1 - b2) / (b1 + b2)"), "rst_nbr": index("(b1 - b2) / (b1 + b2)"), "rst_index": index("(b2 - b1) / (b2 + b1)"),
        **dict.fromkeys(("rst_resample", "rst_resample_to_size", "rst_resample_to_res"), half),
        "rst_retile": parts(24, 24), "rst_tooverlappingtiles": parts(24, 32), "rst_separatebands": f"{b} SELECT DISTINCT tile_id, (band - 1)::INT AS part, 64::INT AS width, 64::INT AS height, 1::INT AS bands FROM p",
        "rst_histogram": f"{p}, t AS (SELECT DISTINCT tile_id FROM p), h AS (SELECT tile_id, least(7, floor(value / 10000))::INT AS bucket, count(*) AS n FROM p WHERE value BETWEEN 0 AND 80000 GROUP BY ALL) SELECT tile_id, k::INT AS bucket, coalesce(n, 0) AS n FROM t CROSS JOIN range(0, 8) r(k) LEFT JOIN h ON h.tile_id = t.tile_id AND h.bucket = k".replace("SELECT tile_id, k::INT", "SELECT t.tile_id, k::INT"),
        "rst_sample": f'{p}, t AS (SELECT DISTINCT tile_id FROM p) SELECT t.tile_id, coalesce(round(value, 2), -9999) AS value FROM t LEFT JOIN p ON p.tile_id = t.tile_id AND p.col = t.tile_id AND p."row" = 9',
        "rst_clip": f'{p} SELECT tile_id, band, round(value, 2) AS value FROM p WHERE col BETWEEN 10 AND 29 AND "row" BETWEEN 20 AND 39',
        "rst_polygonize": f'{b} SELECT tile_id, floor(value / 20000) AS value, count(*)::DOUBLE AS area FROM p WHERE band = 1 GROUP BY tile_id, floor(value / 20000)',
        "rst_rasterize": f"{p}, t AS (SELECT DISTINCT tile_id FROM p) SELECT tile_id, 1::INT AS band, r::INT AS \"row\", c::INT AS col, tile_id + 1.0::DOUBLE AS value FROM t, range(27, 32) a(r), range(0, 32) b(c) WHERE c >= tile_id AND c < tile_id + 10",
        "rst_rasterize_agg": f"{p}, t AS (SELECT DISTINCT tile_id FROM p) SELECT 0::BIGINT AS tile_id, 1::INT AS band, r::INT AS \"row\", c::INT AS col, tile_id::DOUBLE AS value FROM t, range(27, 32) a(r), range(0, 32) b(c) WHERE c // 2 = tile_id",
        **{f"rst_quadbin_rastertogrid{m}": measure(f) for m, f in {"avg": "avg(value)", "count": "count(*)", "max": "max(value)", "min": "min(value)", "median": "median(value)"}.items()}, "pixels_quadbin": measure("avg(value)"),
        "rst_combineavg_agg": whole("avg(value)"), "rst_combineavg": whole("avg(value)"), "rst_merge": whole("arg_max(value, tile_id)"), "rst_derivedband": whole("max(value)"), "rst_derivedband_agg": whole("max(value)"),
        "rst_frombands": f'{p} SELECT 0::BIGINT AS tile_id, (tile_id + 1)::INT AS band, "row", col, round(value, 6) AS value FROM p ', "rst_frombands_agg": f'{p} SELECT 0::BIGINT AS tile_id, (tile_id + 1)::INT AS band, "row", col, round(value, 2) AS value FROM p ',
        "pixels_retile": f'{p} SELECT tile_id, (col // 16)::BIGINT AS window_x, ("row" // 16)::BIGINT AS window_y, count(*) AS n, round(sum(value), 2) AS total FROM p GROUP BY ALL',
        "pixels_statistics": f"{b} SELECT tile_id, band, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median, count(*) AS pixelcount FROM p GROUP BY tile_id, band",
    }
    # Of every pixel, the distance to the nearest one with a value that doesn't round to 0.
    found["rst_proximity"] = f"""{p}, v AS (SELECT * FROM p WHERE floor(abs(value) + 0.5) > 0), g AS (SELECT tile_id, r, c FROM (SELECT DISTINCT tile_id FROM p), range(0, 64) a(r), range(0, 64) b(c))
SELECT g.tile_id, 1::INT AS band, g.r::INT AS "row", g.c::INT AS col, round(sqrt(min((g.r - v."row") * (g.r - v."row") + (g.c - v.col) * (g.c - v.col)) * 100)::FLOAT::DOUBLE, 6) AS value FROM g JOIN v ON v.tile_id = g.tile_id GROUP BY ALL"""
    return found | dict.fromkeys(("rst_fromcontent", "rst_asformat"), f"{p} SELECT {keys}, round(value, 6) AS value FROM p")
