"""Raster functions on tile columns (cellid, raster bytes, metadata), and their aggregates and generators.

Codecs and neighbourhood kernels run in pandas UDFs, an Arrow batch at a time; rasters as
pixel relations, whose operators are plain DataFrame operations, are in
``operators.pixels``. A null tile gives null.
"""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wkb import col
from . import kernels as K
from .codec import Raster, decode, encode

TILE = T.StructType([T.StructField("cellid", T.LongType()), T.StructField("raster", T.BinaryType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
_D, _S, _L, _I, _B = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()
_SHAPES = T.ArrayType(T.StructType([T.StructField("geom_wkb", _B), T.StructField("value", _D)]))
_CELLS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("cellID", _L), T.StructField("measure", _D)])))

ACCESSOR_TYPES = {
    **dict.fromkeys(("avg", "max", "min", "median", "getnodata"), T.ArrayType(_D)), "pixelcount": T.ArrayType(_L), "type": T.ArrayType(_S),
    **dict.fromkeys(("bandmetadata", "metadata", "subdatasets"), T.MapType(_S, _S)), "georeference": T.MapType(_S, _D), "boundingbox": _B,
    **dict.fromkeys(("format", "summary"), _S), **dict.fromkeys(("height", "width", "numbands", "srid", "worldtorastercoordx", "worldtorastercoordy"), _I),
    **dict.fromkeys(("pixelheight", "pixelwidth", "rotation", "scalex", "scaley", "skewx", "skewy", "upperleftx", "upperlefty", "rastertoworldcoordx", "rastertoworldcoordy"), _D), "isempty": T.BooleanType(),
}
#: Functions from a tile to a tile.
TILE_TO_TILE = {n: getattr(K, n) for n in "ndvi evi savi ndwi nbr index threshold initnodata updatetype band setsrid slope aspect hillshade tri tpi roughness convolve fillnodata proximity viewshed resample resample_to_size resample_to_res transform to_webmercator buildoverviews cog_convert clip color_relief".split()} | {"filter": K.filter_}
#: Functions from a tile to several.
TILE_TO_TILES = {n: getattr(K, n) for n in ("retile", "tooverlappingtiles", "maketiles", "separatebands")}
#: Functions from a tile to other values.
TILE_TO_VALUE = {
    "histogram": (K.histogram, T.MapType(_S, T.ArrayType(_L))), "sample": (K.sample, T.ArrayType(_D)), "polygonize": (K.polygonize, _SHAPES), "contour": (K.contour, _SHAPES), "tilexyz": (K.tilexyz, _B),
    "xyzpyramid": (K.xyzpyramid, T.ArrayType(T.StructType([T.StructField(c, _I) for c in "zxy"] + [T.StructField("bytes", _B)]))),
    **{f"quadbin_rastertogrid{m}": (lambda r, res, m=m: K.raster_to_quadbin(r, res, m), _CELLS) for m in ("avg", "count", "max", "min", "median")},
}
#: Functions from an array of tiles to a tile.
TILES_TO_TILE = {n: getattr(K, n) for n in ("frombands", "combineavg", "merge", "mapalgebra", "derivedband")}


#: Functions that ``rst`` builds itself.
OTHERS = ("memsize", "tryopen", "rastertoworldcoord", "worldtorastercoord", "asformat", "getsubdataset", "rasterize", "gridfrompoints")


def _plain(v):
    """A kernel's argument: None for a missing number, SQL's decimals as floats."""
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)) and len(v) and isinstance(v[0], (Decimal, list, np.ndarray)):
        return [_plain(x) for x in v]
    return v


def _udf(f, kind):
    @F.pandas_udf(kind)
    def run(raster: pd.Series, *args: pd.Series) -> pd.Series:
        out = []
        for data, *more in zip(raster, *args, strict=True):
            if data is None:
                out.append(None)
                continue
            more = [_plain(m) for m in more]
            while more and more[-1] is None:
                more.pop()
            out.append(f(decode(bytes(data)), *more))
        return pd.Series(out, dtype=object)

    return run


def as_tile(raster: Column, cellid: Column | None = None) -> Column:
    """A tile struct around encoded bytes; null for null."""
    meta = F.create_map(F.lit("driver"), F.lit("GTiff"))
    return F.when(raster.isNotNull(), F.struct((F.lit(0).cast("long") if cellid is None else cellid).alias("cellid"), raster.alias("raster"), meta.alias("metadata")))


def _arg(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (list, tuple)):
        return F.array(*map(_arg, v))
    if isinstance(v, dict):
        return F.create_map(*(F.lit(x) for kv in v.items() for x in kv))
    return F.lit(v)


def _encoded(f):
    def run(r: Raster, *args):
        made = f(r, *[dict(a) if isinstance(a, list) and a and isinstance(a[0], tuple) else a for a in args])
        return None if made is None else encode(made)

    return run


def rst(name: str, tile, *args) -> Column:
    """The raster function of this name: ``rst("slope", "tile", "percent")``. Literals and Columns are both taken."""
    t = col(tile)
    more = [_arg(a) for a in args]
    if name in ACCESSOR_TYPES:
        return _udf(K.ACCESSORS[name], ACCESSOR_TYPES[name])(t["raster"], *more)
    if name in TILE_TO_TILE:
        return as_tile(_udf(_encoded(TILE_TO_TILE[name]), _B)(t["raster"], *more), t["cellid"])
    if name in TILE_TO_TILES:
        f = TILE_TO_TILES[name]
        parts = _udf(lambda r, *a: [encode(p) for p in f(r, *a)], T.ArrayType(_B))(t["raster"], *more)
        return F.transform(parts, lambda p: as_tile(p))
    if name in TILE_TO_VALUE:
        return _udf(*TILE_TO_VALUE[name])(t["raster"], *more)
    if name in TILES_TO_TILE:
        f = TILES_TO_TILE[name]

        @F.pandas_udf(_B)
        def run(rasters: pd.Series, *a: pd.Series) -> pd.Series:
            return pd.Series([None if rs is None or not len(rs) else encode(f([decode(bytes(r)) for r in rs], *more)) for rs, *more in zip(rasters, *a, strict=True)], dtype=object)

        return as_tile(run(F.transform(t, lambda x: x["raster"]), *more))
    if name == "memsize":
        return F.octet_length(t["raster"]).cast("long")
    if name == "tryopen":
        return F.pandas_udf(lambda s: s.map(lambda d: d is not None and K.tryopen(d)), T.BooleanType())(t["raster"])
    if name == "rastertoworldcoord":
        return F.struct(rst("rastertoworldcoordx", tile, *args).alias("x"), rst("rastertoworldcoordy", tile, *args).alias("y"))
    if name == "worldtorastercoord":
        return F.struct(rst("worldtorastercoordx", tile, *args).alias("x"), rst("worldtorastercoordy", tile, *args).alias("y"))
    if name == "asformat":
        return F.when(_arg(args[0]).isin("GTiff", "COG"), t).otherwise(F.raise_error(F.lit("only GTiff is written")).cast(TILE))
    if name == "getsubdataset":
        return F.lit(None).cast(TILE)  # a GeoTIFF holds one dataset
    if name == "rasterize":
        @F.pandas_udf(_B)
        def burn(g: pd.Series, v: pd.Series, *a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else encode(K.rasterize([(x, y)], *more)) for x, y, *more in zip(g, v, *a, strict=True)], dtype=object)

        return as_tile(burn(t, *more))
    if name == "gridfrompoints":
        @F.pandas_udf(_B)
        def idw(p: pd.Series, v: pd.Series, *a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else encode(K.gridfrompoints(x, y, *more)) for x, y, *more in zip(p, v, *a, strict=True)], dtype=object)

        return as_tile(idw(t, *more))
    raise ValueError(f"no raster function {name!r}")


def fromcontent(content, driver="GTiff") -> Column:
    """A tile around encoded bytes."""
    return F.when(col(content).isNotNull(), F.struct(F.lit(0).cast("long").alias("cellid"), col(content).alias("raster"), F.create_map(F.lit("driver"), _arg(driver)).alias("metadata")))


@F.pandas_udf(_B)
def _bytes_of(paths: pd.Series) -> pd.Series:
    from pyarrow import fs

    out = []
    for p in paths:
        if p is None:
            out.append(None)
            continue
        store, name = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
        with store.open_input_stream(name) as f:
            out.append(f.read())
    return pd.Series(out, dtype=object)


def fromfile(path, driver="GTiff") -> Column:
    """A tile of the file at each path, which all executors must be able to open; null for null. For many files ``read_tiles`` plans better."""
    return fromcontent(_bytes_of(col(path)), driver)


def apply(tile, fn, return_type) -> Column:
    """A user's function of each tile's Raster."""
    return _udf(fn, return_type)(col(tile)["raster"])


# Aggregates: a group's tiles reach one task, as one tile is their result


def _agg(f):
    @F.pandas_udf(_B)
    def run(rasters: pd.Series, *args: pd.Series) -> bytes:
        found = sorted(bytes(r) for r in rasters if r is not None)  # an order that the input's doesn't change
        return encode(f([decode(r) for r in found], *[a.iloc[0] for a in args])) if found else None

    return run


def combineavg_agg(tile) -> Column:
    return as_tile(_agg(K.combineavg)(col(tile)["raster"]))


def merge_agg(tile) -> Column:
    return as_tile(_agg(K.merge)(col(tile)["raster"]))


def derivedband_agg(tile, source: str, name: str) -> Column:
    return as_tile(_agg(lambda rs: K.derivedband(rs, source, name))(col(tile)["raster"]))


def frombands_agg(tile, band_index) -> Column:
    @F.pandas_udf(_B)
    def run(rasters: pd.Series, order: pd.Series) -> bytes:
        found = sorted((int(o), bytes(r)) for r, o in zip(rasters, order, strict=True) if r is not None)
        return encode(K.frombands([decode(r) for _, r in found])) if found else None

    return as_tile(run(col(tile)["raster"], col(band_index)))


def rasterize_agg(geom, value, *extent) -> Column:
    @F.pandas_udf(_B)
    def run(g: pd.Series, v: pd.Series) -> bytes:
        return encode(K.rasterize(list(zip(g, v, strict=True)), *extent))

    return as_tile(run(col(geom), col(value)))


def gridfrompoints_agg(point, value, *extent) -> Column:
    @F.pandas_udf(_B)
    def run(p: pd.Series, v: pd.Series) -> bytes:
        rows = sorted((bytes(a), float(b)) for a, b in zip(p, v, strict=True) if a is not None and b is not None)
        return encode(K.gridfrompoints([r[0] for r in rows], [r[1] for r in rows], *extent))

    return as_tile(run(col(point), col(value)))


def overview(tile, k: int) -> Column:
    """A tile of the file's k-th overview (from 1), null if there are fewer; its pixels are as many times larger."""

    def reduced(r: Raster):
        if not 0 < k <= len(r.overviews):
            return None
        bands = r.overviews[k - 1]
        x, y = r.width / bands.shape[2], r.height / bands.shape[1]
        return encode(r.like(bands, gt=(r.gt[0], r.gt[1] * x, r.gt[2] * y, r.gt[3], r.gt[4] * x, r.gt[5] * y)))

    @F.pandas_udf(_B)
    def run(raster: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else reduced(decode(bytes(d), reduced=True)) for d in raster], dtype=object)

    return as_tile(run(col(tile)["raster"]))


def read_tiles(spark, path: str, pattern: str = "*.tif*") -> DataFrame:
    """source and tile of the GeoTIFF files under a path, one a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("source"), fromcontent("content").alias("tile"))


def from_pixels(pixels: DataFrame, width: int, height: int, gt=(0.0, 1.0, 0.0, 0.0, 0.0, -1.0), srid: int = 0, nodata: float = K.NODATA) -> DataFrame:
    """tile_id and tile from a pixel relation (tile_id, band, row, col, value)."""
    @F.pandas_udf(_B)
    def build(band: pd.Series, row: pd.Series, column: pd.Series, value: pd.Series) -> bytes:
        out = np.full((int(band.max()), height, width), nodata)
        out[band.to_numpy() - 1, row.to_numpy(), column.to_numpy()] = value.fillna(nodata).to_numpy()
        return encode(Raster(out, gt, srid, nodata))

    return pixels.groupBy("tile_id").agg(as_tile(build("band", "row", "col", "value")).alias("tile"))


def to_pixels(tiles: DataFrame, tile: str = "tile", *keep: str) -> DataFrame:
    """The pixel relation of valid pixels: kept columns, band, row, col, value."""
    kind = T.ArrayType(T.StructType([T.StructField(c, _I) for c in ("band", "row", "col")] + [T.StructField("value", _D)]))

    def listed(r: Raster):
        b, q, c = np.nonzero(r.valid())
        return [{"band": int(x) + 1, "row": int(y), "col": int(z), "value": float(v)} for x, y, z, v in zip(b, q, c, r.bands[b, q, c], strict=True)]

    return tiles.select(*keep, F.inline(_udf(listed, kind)(F.col(tile)["raster"])))
