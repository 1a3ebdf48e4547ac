"""Raster operators on pixel relations (tile_id, band, row, col, value): joins, windows and aggregates alone.

Here a raster is rows, so filters push down, aggregates combine before the shuffle, and a
tile of any size is spread over tasks. A missing row is NoData. Terrain operators need a
whole 3 x 3 neighbourhood; focal ones take what is there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quadbin

KEYS = ("tile_id", "band", "row", "col")


def shifted(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Each valid neighbour of each position as (keys, dr, dc, near): a pixel is sent to the (2 reach + 1)^2 positions around it, without a join."""
    steps = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    sent = pixels.select("tile_id", "band", "row", "col", "value", F.inline(steps))
    return sent.select("tile_id", "band", (F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", F.col("value").alias("near"))


def neighbourhood(pixels: DataFrame, *aggregates: Column, reach: int = 1, whole: bool = True) -> DataFrame:
    """Aggregates over the neighbours of valid pixels; with ``whole``, only where all are valid."""
    grouped = shifted(pixels, reach).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("near"))).alias("__centre"), *aggregates)
    return grouped.where("__centre is not null" + (f" and __n = {(2 * reach + 1) ** 2}" if whole else ""))


def _weighted(weights: dict[tuple[int, int], float]) -> Column:
    total = F.lit(0.0)
    for (dr, dc), w in weights.items():
        total = F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("near") * w).otherwise(total)
    return F.sum(total)


_GX = {(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1}
_GY = {(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1}


def slope(pixels: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Horn slope in degrees; dx and dy are pixel sizes in the unit of the values."""
    grid = neighbourhood(pixels, (_weighted(_GX) / (8 * dx)).alias("gx"), (_weighted(_GY) / (8 * dy)).alias("gy"))
    return grid.select(*KEYS, F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("value"))


def aspect(pixels: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Horn aspect, compass degrees; flat pixels have none."""
    grid = neighbourhood(pixels, (_weighted(_GX) / dx).alias("gx"), (_weighted(_GY) / dy).alias("gy")).where("gx <> 0 or gy <> 0")
    return grid.select(*KEYS, F.pmod(90 - F.degrees(F.atan2("gy", -F.col("gx"))), F.lit(360.0)).alias("value"))


def tri(pixels: DataFrame) -> DataFrame:
    """Root of the summed squared differences to the eight neighbours."""
    grid = neighbourhood(pixels, F.collect_list("near").alias("ns"))
    return grid.select(*KEYS, F.sqrt(F.aggregate("ns", F.lit(0.0), lambda s, v: s + (v - F.col("__centre")) * (v - F.col("__centre")))).alias("value"))


def tpi(pixels: DataFrame) -> DataFrame:
    grid = neighbourhood(pixels, F.sum("near").alias("total"))
    return grid.select(*KEYS, (F.col("__centre") - (F.col("total") - F.col("__centre")) / 8).alias("value"))


def roughness(pixels: DataFrame) -> DataFrame:
    return neighbourhood(pixels, (F.max("near") - F.min("near")).alias("value")).select(*KEYS, "value")


def focal(pixels: DataFrame, size: int, operation: str, width: int, height: int) -> DataFrame:
    """avg, min, max, median or mode over the valid pixels of an odd window, at every place of the tile that has any."""
    f = {"avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5)), "mode": lambda c: F.mode(c, True)}[operation]
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return shifted(pixels, size // 2).where(inside).groupBy(*KEYS).agg(f("near").alias("value"))


def convolve(pixels: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Correlation with an odd square kernel that isn't flipped; invalid neighbours count 0."""
    reach = len(kernel) // 2
    weights = {(i - reach, j - reach): v for i, row in enumerate(kernel) for j, v in enumerate(row)}
    return neighbourhood(pixels, _weighted(weights).alias("value"), reach=reach, whole=False).select(*KEYS, "value")


def statistics(pixels: DataFrame) -> DataFrame:
    """avg, min, max, median and count of valid pixels by tile and band."""
    return pixels.groupBy("tile_id", "band").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.lit(0.5)).alias("median"), F.count("value").alias("pixelcount"))


def map_algebra(pixels: DataFrame, expression: str, bands: dict[str, int]) -> DataFrame:
    """A SQL expression over named bands of one relation; a pixel that lacks one has no result. Catalyst evaluates it."""
    names = list(bands)
    wide = pixels.where(F.col("band").isin(list(bands.values()))).groupBy("tile_id", "row", "col").agg(*(F.max(F.when(F.col("band") == bands[n], F.col("value"))).alias(n) for n in names))
    result = wide.where(" and ".join(f"{n} is not null" for n in names)).withColumn("value", F.expr(expression))
    return result.where("value is not null").select("tile_id", F.lit(1).alias("band"), "row", "col", "value")


def centres(pixels: DataFrame, gt: tuple[float, ...]) -> DataFrame:
    """The pixels with x and y of their centres."""
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return pixels.withColumns({"x": gt[0] + gt[1] * c + gt[2] * r, "y": gt[3] + gt[4] * c + gt[5] * r})


def to_quadbin(pixels: DataFrame, gt: tuple[float, ...], res: int, *measures: str) -> DataFrame:
    """Measures (avg, count, max, min, median) of the pixels of each cell by tile and band, of a grid in degrees."""
    f = {"avg": F.avg("value"), "count": F.count("value"), "max": F.max("value"), "min": F.min("value"), "median": F.percentile("value", F.lit(0.5))}
    placed = centres(pixels, gt).withColumn("cell", quadbin.pointascell("x", "y", F.lit(res)))
    return placed.groupBy("tile_id", "band", "cell").agg(*(f[m].alias(m) for m in measures))


def merge(pixels: DataFrame, order: str) -> DataFrame:
    """One relation from many that lie on one grid: where several have a pixel, the greatest ``order`` wins."""
    return pixels.groupBy("band", "row", "col").agg(F.max_by("value", order).alias("value"))


def combine_avg(pixels: DataFrame) -> DataFrame:
    """Mean of the valid pixels of all tiles on one grid."""
    return pixels.groupBy("band", "row", "col").agg(F.avg("value").alias("value"))


def retile(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The pixels of non-overlapping windows, each with its window's number and own rows and columns."""
    return pixels.select("tile_id", "band", F.floor(F.col("col") / width).alias("window_x"), F.floor(F.col("row") / height).alias("window_y"), (F.col("row") % height).alias("row"), (F.col("col") % width).alias("col"), "value")


def metres_per_degree(lat: float) -> tuple[float, float]:
    """Scale of degrees at a latitude, as terrain functions use it for geographic systems."""
    return 111_320.0 * math.cos(math.radians(lat)), 111_320.0
