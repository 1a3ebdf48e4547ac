"""Points, cells, polygons and pixels derived from the driver's tables, which carry no coordinates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all machines share; a folder of this machine only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='groundweave-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POINTS_SQL = "SELECT event_id, (user_id * 37 % 36000) / 100.0::DOUBLE - 180 AS lon, (event_id * 53 % 17000) / 100.0::DOUBLE - 85 AS lat, value FROM events"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, lon, lat, value of every event."""
    lon = (F.col("user_id") * 37 % 36000) / F.lit(100.0) - 180
    lat = (F.col("event_id") * 53 % 17000) / F.lit(100.0) - 85
    return table(spark, sf_dir, "events").select("event_id", lon.alias("lon"), lat.alias("lat"), "value")


GRID_SQL = "SELECT o_orderkey AS id, o_orderkey * 97 % 700000 AS e, o_custkey * 131 % 1300000 AS n FROM orders"


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, easting and northing of every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 97 % 700000).alias("e"), (F.col("o_custkey") * 131 % 1300000).alias("n"))


PIXELS_SQL = 'SELECT l_suppkey % 16 AS tile_id, 1 AS band, (l_orderkey % 64)::INT AS "row", (l_partkey % 64)::INT AS col, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL'


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel relation: tile_id, band, row, col, value; a pixel that no line has is NoData."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("tile_id"), F.lit(1).alias("band"), (F.col("l_orderkey") % 64).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col"), "l_extendedprice")
    return rows.groupBy("tile_id", "band", "row", "col").agg(F.max("l_extendedprice").alias("value"))
