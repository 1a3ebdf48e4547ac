"""Quadbin cells (64-bit web-mercator tile ids) as native Column expressions.

Layout: bit 62 header, bits 59-61 mode 1, bits 52-58 zoom, then 52 bits of interleaved
x and y of which the lowest unused ones are set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wkb import box_wkb, col, point_wkb

MAX_RESOLUTION, MAX_POLYFILL_RESOLUTION, MAX_CELLS = 26, 20, 1_000_000
MAX_LATITUDE = 85.05112878
_HEADER = 0x4800000000000000


def _spread(v: Column) -> Column:
    """A blank bit after each bit: the binary digits read as digits to base 4."""
    return F.conv(F.bin(v.cast("long")), 4, 10).cast("long")


def _gather(body: Column, digits: str) -> Column:
    """Every second bit: each digit to base 4 mapped to one binary digit."""
    return F.conv(F.translate(F.conv(body.cast("string"), 10, 4), "0123", digits), 2, 10).cast("long")


def _shift(v: Column, by: Column) -> Column:
    return F.call_function("shiftleft", v, by.cast("int"))


def from_tile(z, x, y) -> Column:
    """The cell of tile (z, x, y)."""
    z, x, y = col(z).cast("int"), col(x).cast("long"), col(y).cast("long")
    lift = lambda v: _shift(v, 26 - z)  # noqa: E731  to 26 bits, whatever the zoom
    morton = _spread(lift(x)).bitwiseOR(F.shiftleft(_spread(lift(y)), 1))
    unused = F.call_function("shiftrightunsigned", F.lit((1 << 52) - 1), (z * 2).cast("int"))
    return F.lit(_HEADER).bitwiseOR(F.shiftleft(z.cast("long"), 52)).bitwiseOR(morton).bitwiseOR(unused)


def resolution(cell) -> Column:
    return F.shiftrightunsigned(col(cell).cast("long"), 52).bitwiseAND(F.lit(0x1F)).cast("int")


def tile(cell) -> tuple[Column, Column, Column]:
    """(z, x, y) of a cell."""
    cell = col(cell).cast("long")
    z = resolution(cell)
    body = cell.bitwiseAND(F.lit((1 << 52) - 1))
    drop = lambda v: F.call_function("shiftrightunsigned", v, 26 - z)
    return z, drop(_gather(body, "0101")), drop(_gather(body, "0011"))


def _checked(res, most: int) -> Column:
    r = col(res).cast("int")
    return F.when((r >= 0) & (r <= most), r).when(r.isNotNull(), F.raise_error(F.concat(F.lit(f"resolution must be 0 to {most}, not "), r.cast("string"))).cast("int"))


def tile_of_point(lon, lat, res) -> tuple[Column, Column]:
    """(x, y) of the tile that holds a point; latitudes and tiles are clamped, nothing wraps."""
    n = F.pow(F.lit(2.0), res.cast("double"))
    lat = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), col(lat).cast("double")))
    s = F.sin(F.radians(lat))
    x = F.floor((col(lon).cast("double") + 180.0) / 360.0 * n)
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n)
    clamp = lambda v: F.greatest(F.lit(0).cast("double"), F.least(n - 1, v.cast("double"))).cast("long")
    return clamp(x), clamp(y)


def pointascell(lon, lat, res) -> Column:
    r = _checked(res, MAX_RESOLUTION)
    x, y = tile_of_point(lon, lat, r)
    return from_tile(r, x, y)


def bounds(cell) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees."""
    z, x, y = tile(cell)
    n = F.pow(F.lit(2.0), z.cast("double"))
    lon = lambda v: v / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return lon(x), lat(y + 1), lon(x + 1), lat(y)


def aswkb(cell) -> Column:
    return box_wkb(*bounds(cell), srid=4326)


def centroid_xy(cell) -> tuple[Column, Column]:
    """Mean of the corners, in degrees."""
    west, south, east, north = bounds(cell)
    return (west + east) / 2, (south + north) / 2


def centroid(cell) -> Column:
    return point_wkb(*centroid_xy(cell), srid=4326)


def distance(cell_a, cell_b) -> Column:
    """Chebyshev distance in tiles of two cells of one resolution."""
    z1, x1, y1 = tile(cell_a)
    z2, x2, y2 = tile(cell_b)
    far = F.greatest(F.abs(x1 - x2), F.abs(y1 - y2)).cast("int")
    return F.when(z1 == z2, far).when(z1.isNotNull() & z2.isNotNull(), F.raise_error(F.lit("cells of different resolutions")).cast("int"))


def _cells(z: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The cells of a block of tiles, row by row. One lambda: Spark can't hand nested ones to a Python function above."""
    size = ((x1 - x0 + 1) * (y1 - y0 + 1)).cast("int")
    block = F.array_repeat(F.struct(z.alias("z"), x0.alias("x"), y0.alias("y"), (x1 - x0 + 1).alias("n")), size)
    return F.transform(block, lambda t, i: from_tile(t["z"], t["x"] + i % t["n"], t["y"] + F.floor(i / t["n"])))


def kring(cell, k) -> Column:
    """Cells within k tiles, cut at the edge of the world."""
    z, x, y = tile(cell)
    k = col(k).cast("long")
    top = (F.pow(F.lit(2.0), z.cast("double")) - 1).cast("long")
    low = lambda v: F.greatest(F.lit(0).cast("long"), v - k)
    high = lambda v: F.least(top, v + k)
    return _cells(z, low(x), high(x), low(y), high(y))


def polyfill_box(west, south, east, north, res) -> Column:
    """Every cell of an envelope; at most ``MAX_CELLS``, else an error."""
    r = _checked(res, MAX_POLYFILL_RESOLUTION)
    x0, y0 = tile_of_point(west, north, r)
    x1, y1 = tile_of_point(east, south, r)
    count = (x1 - x0 + 1) * (y1 - y0 + 1)
    return F.when(count <= MAX_CELLS, _cells(r, x0, x1, y0, y1)).otherwise(F.raise_error(F.lit("too many cells")).cast("array<bigint>"))
