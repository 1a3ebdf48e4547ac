"""Counts of a stream's points by time window and quadbin cell, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quadbin


def cell_counts(stream: DataFrame, res: int, *, lon: str = "lon", lat: str = "lat", time: str = "ts", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, cell, n of a stream or a table; rows later than ``late`` are dropped by a stream."""
    placed = stream.withColumn("cell", quadbin.pointascell(lon, lat, F.lit(res)))
    return placed.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "cell").agg(F.count(F.lit(1)).alias("n"))
