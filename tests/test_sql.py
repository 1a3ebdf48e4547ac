"""SQL names: each function through ``spark.sql`` gives what its Column builder gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundweave import sql
from groundweave.functions import cells, quadbin
from groundweave.plans import registry
from groundweave.raster.codec import Raster, encode
from groundweave.raster.functions import fromcontent

BOX = "unhex('0103000000010000000500000000000000000000000000000000000000000000000000F03F0000000000000000000000000000F03F000000000000F03F0000000000000000000000000000F03F00000000000000000000000000000000')"
CALLS = {
    "quadbin_pointascell": "(10.0, 50.0, 6)", "quadbin_resolution": "(cell)", "quadbin_centroid": "(cell)", "quadbin_aswkb": "(cell)", "quadbin_distance": "(cell, cell)", "quadbin_kring": "(cell, 1)", "quadbin_polyfill": f"({BOX}, 8)",
    "quadbin_tessellate": f"({BOX}, 8)", "quadbin_cellunion": "(array(cell))", "quadbin_cellunion_agg": "(cell)", "bng_aswkb": "('TQ3080')", "bng_aswkt": "('TQ3080')", "bng_centroid": "('TQ3080')", "bng_cellarea": "('TQ3080')", "bng_distance": "('TQ3080', 'TQ3081')",
    "bng_euclideandistance": "('TQ3080', 'TQ3081')", "bng_kring": "('TQ3080', 1)", "bng_kloop": "('TQ3080', 1)", "bng_kringexplode": "('TQ3080', 1)", "bng_kloopexplode": "('TQ3080', 1)", "bng_eastnorthasbng": "(530000, 180000, '1km')", "bng_pointascell": f"({BOX}, '1km')",
    "bng_polyfill": f"({BOX}, '1m')", "bng_tessellate": f"({BOX}, '1m')", "bng_tessellateexplode": f"({BOX}, '1m')", "bng_geomkring": f"({BOX}, '1m', 1)", "bng_geomkloop": f"({BOX}, '1m', 1)", "bng_geomkringexplode": f"({BOX}, '1m', 1)", "bng_geomkloopexplode": f"({BOX}, '1m', 1)",
    "custom_grid": "(0, 100, 0, 100, 2, 10, 10)", "custom_cellaswkb": "(12, grid)", "custom_cellaswkt": "(12, grid)", "custom_centroid": "(12, grid)", "custom_kring": "(12, grid, 1)", "custom_polyfill": f"({BOX}, grid, 3)", "custom_pointascell": f"({BOX}, grid, 1)",
    "rst_avg": "(tile)", "rst_width": "(tile)", "rst_metadata": "(tile)", "rst_slope": "(tile)", "rst_threshold": "(tile, '>', 3.0)", "rst_filter": "(tile, 3, 'avg')", "rst_retile": "(tile, 4, 4)", "rst_separatebands": "(tile)", "rst_histogram": "(tile, 4, 0.0, 64.0)",
    "rst_memsize": "(tile)", "rst_tryopen": "(tile)", "rst_rastertoworldcoord": "(tile, 1, 2)", "rst_convolve": "(tile, array(array(0.0, 1.0, 0.0), array(1.0, 1.0, 1.0), array(0.0, 1.0, 0.0)))", "rst_polygonize": "(tile)", "rst_merge": "(array(tile, tile))",
    "rst_merge_agg": "(tile)", "rst_combineavg_agg": "(tile)", "rst_frombands_agg": "(tile, 1)", "rst_rasterize_agg": f"({BOX}, 1.0, 0.0, 0.0, 2.0, 2.0, 4, 4, 4326)", "rst_quadbin_rastertogridavg": "(tile, 5)", "rst_fromcontent": "(tile.raster)", "rst_xyzpyramid": "(tile, 0, 1, 'PNG', 16)",
    "st_asmvt": f"({BOX}, named_struct('a', 1), 'layer')", "st_asmvt_pyramid": f"({BOX}, named_struct('a', 1), 3, 4, 'layer')", "pmtiles_agg": "(x'89504E47', 0, 0, 0)",
}


@pytest.fixture(scope="module")
def named(spark):
    sql.register(spark)
    data = encode(Raster(np.arange(64.0).reshape(1, 8, 8), (10.0, 0.5, 0.0, 50.0, 0.0, -0.5), 4326, -1.0))
    one = spark.createDataFrame([(bytearray(data),)], "raster binary").select(fromcontent("raster").alias("tile"), quadbin.pointascell(F.lit(10.0), F.lit(50.0), F.lit(6)).alias("cell"))
    one.selectExpr("*", "gw_custom_grid(0, 100, 0, 100, 2, 10, 10) AS grid").createOrReplaceTempView("one")
    return spark


@pytest.mark.parametrize("name", sorted(CALLS))
def test_call(named, name):
    rows = named.sql(f"SELECT gw_{name}{CALLS[name]} FROM one").collect()
    assert rows and any(v is not None for v in rows[0])


def test_every_query_has_a_name(named):
    functions = {n for n in registry.queries() if n.startswith(("quadbin_", "bng_", "custom_", "rst_", "st_", "pmtiles_")) and n not in ("rst_filter_max", "rst_filter_median", "rst_filter_mode")}
    assert functions <= set(sql.names())
    assert set(sql.registered(named)) >= {f"gw_{n}" for n in sql.names()}


def test_native_functions_stay_native(named):
    plan = named.sql("SELECT gw_quadbin_kring(gw_quadbin_pointascell(id, id, 5), 1) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chains_and_groups(named):
    got = named.sql("SELECT id % 2 AS g, gw_quadbin_cellunion_agg(gw_quadbin_pointascell(id, id, 5)) AS u FROM range(30) GROUP BY id % 2")
    want = named.range(30).groupBy((F.col("id") % 2).alias("g")).agg(cells.quadbin_cellunion_agg(quadbin.pointascell("id", "id", F.lit(5))).alias("u"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_and_errors(spark):
    assert sql.register(spark, only=["quadbin_kring"], prefix="x_") == ["x_quadbin_kring"]
    assert sql.registered(spark, "x_") == ["x_quadbin_kring"]
    with pytest.raises(ValueError):
        sql.register(spark, only=["nothing"])
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT gw_bng_polyfill(x'00', string(id)) FROM range(2)").collect()


def test_fromfile(named, tmp_path):
    path = tmp_path / "a.tif"
    path.write_bytes(named.table("one").first().tile.raster)
    got = named.sql(f"SELECT gw_rst_width(gw_rst_fromfile('file://{path}')) AS a, gw_rst_height(gw_rst_fromfile('{path}')) AS b, gw_rst_fromfile(CAST(NULL AS STRING)) IS NULL AS c").first()
    assert tuple(got) == (8, 8, True)
