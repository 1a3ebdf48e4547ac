"""Queries that write files in each format and read them back, and a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, quadbin
from ..functions.wkb import point_wkb
from ..sources.formats import register_formats, shard_column
from ..streaming.cells import cell_counts
from .derive import PIXELS_SQL, POINTS_SQL, points, scratch
from .raster_queries import _shown, _tiles


def _vector(kind: str, **options):
    def query(spark, sf_dir):
        register_formats(spark)
        path = scratch(spark, kind)
        made = points(spark, sf_dir).select("event_id", "value", (F.col("event_id") % 2 == 0).alias("even"), F.concat(F.lit("événement "), F.col("event_id")).alias("label"), point_wkb(F.col("lon"), F.col("lat")).alias("geom_0"))
        made.repartition(3).write.format(f"gw_{kind}").mode("append").save(path)
        found = spark.read.format(f"gw_{kind}").options(**options).load(path)
        p = cells.first_coordinate("geom_0")
        return found.select("event_id", F.round("value", 6).alias("value"), "even", "label", "geom_0_srid", p.alias("p")).select("event_id", "value", "even", "label", "geom_0_srid", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))

    return query


def source_raster(spark, sf_dir):
    register_formats(spark)
    path = scratch(spark, "raster")
    _tiles(spark, sf_dir).select(F.concat(F.lit("tile"), F.col("tile_id")).alias("name"), "tile").write.format("gw_raster").mode("append").option("nameCol", "name").save(path)
    found = spark.read.format("gw_gtiff").load(path).withColumn("tile_id", F.regexp_extract("source", r"tile(\d+)", 1).cast("long"))
    return _shown(found)


def source_pmtiles(spark, sf_dir):
    """Counts of events by tile of zoom 2 and 8, through archives sharded at zoom 4."""
    register_formats(spark)
    path = scratch(spark, "pmtiles")
    at = [points(spark, sf_dir).select(F.lit(z).alias("z"), *(v.cast("int").alias(c) for c, v in zip("xy", quadbin.tile_of_point("lon", "lat", F.lit(z)), strict=True))) for z in (2, 8)]
    tiles = at[0].union(at[1]).groupBy("z", "x", "y").agg(F.count(F.lit(1)).cast("string").cast("binary").alias("bytes"))
    tiles.repartition(shard_column("z", "x", "y", 4)).write.format("gw_pmtiles").mode("append").option("shardZoom", 4).save(path)
    found = spark.read.format("gw_pmtiles").load(path)
    return found.select("z", "x", "y", F.col("bytes").cast("string").cast("long").alias("n"))


def stream_cell_counts(spark, sf_dir):
    """Windowed counts of the events by cell, as a stream of files gives them when it has read all."""
    rows = points(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 86400))
    path = scratch(spark, "stream")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = f"counts_{path.rsplit('-', 1)[1]}"
    query = cell_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("long").alias("start"), "cell", "n")


def queries() -> dict:
    found = {f"source_{kind}": _vector(kind, **options) for kind, options in {"geojson": {}, "geojsonl": {"splitBytes": "20000"}, "shapefile": {"chunkSize": "700"}, "gpkg": {"chunkSize": "700"}}.items()}
    return found | {"source_raster": source_raster, "source_pmtiles": source_pmtiles, "stream_cell_counts": stream_cell_counts}


def oracle_sql() -> dict[str, str]:
    from .grid_queries import _point_cte

    vector = f"WITH p AS ({POINTS_SQL}) SELECT event_id, round(value, 6) AS value, event_id % 2 = 0 AS even, 'événement ' || event_id AS label, '4326' AS geom_0_srid, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p"
    at = lambda z: f"SELECT {z}::INT AS z, x::INT AS x, y::INT AS y, count(*) AS n FROM ({_point_cte(z)} SELECT x, y FROM t) GROUP BY ALL"
    return {
        **dict.fromkeys(("source_geojson", "source_geojsonl", "source_shapefile", "source_gpkg"), vector),
        "source_raster": f'WITH p AS ({PIXELS_SQL}) SELECT tile_id, band, "row", col, round(value, 6) AS value FROM p',
        "stream_cell_counts": f"{_point_cte(4)} SELECT (1700000000 + event_id % 86400) // 600 * 600 AS start, cell, count(*) AS n FROM c GROUP BY ALL",
        "source_pmtiles": f"{at(2)} UNION ALL {at(8)}",
    }
