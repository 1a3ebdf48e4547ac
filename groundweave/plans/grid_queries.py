"""Queries over the three grids, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bng, cells, custom_grid, quadbin
from .derive import GRID_SQL, POINTS_SQL, national, points

# SQL text of the same arithmetic, for DuckDB


# Masks of the Morton spread, by shift.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread_sql(v: str) -> str:
    for shift, mask in _SPREAD:
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


def _point_cte(z: int) -> str:
    """CTE c: every point with its tile (x, y) and cell at zoom z."""
    s = "sin(radians(least(85.05112878, greatest(-85.05112878, lat))))"
    n = float(2**z)
    return f"""WITH p AS ({POINTS_SQL}),
t AS (SELECT *, least({n} - 1, greatest(0, floor((lon + 180) / 360 * {n})))::BIGINT AS x, least({n} - 1, greatest(0, floor((0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * {n})))::BIGINT AS y FROM p),
w AS (SELECT *, x << {26 - z} AS wx, y << {26 - z} AS wy FROM t),
c AS (SELECT *, {quadbin._HEADER} | ({z}::BIGINT << 52) | {_spread_sql("wx")} | ({_spread_sql("wy")} << 1) | {((1 << 52) - 1) >> (2 * z)} AS cell FROM w)"""


def _with_cells(spark, sf_dir, z):
    return points(spark, sf_dir).withColumn("cell", quadbin.pointascell("lon", "lat", F.lit(z)))


def events_by_cell(spark, sf_dir):
    """Flagship: events, sum and mean of value by zoom-6 cell; the ten fullest cells."""
    found = _with_cells(spark, sf_dir, 6).groupBy("cell").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("sum_value"), F.round(F.avg("value"), 6).alias("avg_value"))
    return found.orderBy(F.desc("n_events"), "cell").limit(10)


def quadbin_pointascell(spark, sf_dir):
    return _with_cells(spark, sf_dir, 14).select("event_id", "cell")


def quadbin_resolution(spark, sf_dir):
    return _with_cells(spark, sf_dir, 9).select("event_id", quadbin.resolution("cell").alias("resolution"))


def quadbin_centroid(spark, sf_dir):
    p = cells.centroid_of(quadbin.centroid("cell"))
    found = _with_cells(spark, sf_dir, 8).select("event_id", p.alias("p"))
    return found.select("event_id", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"))


def quadbin_aswkb(spark, sf_dir):
    b = cells.bounds_of(quadbin.aswkb("cell"))
    found = _with_cells(spark, sf_dir, 8).select("event_id", b.alias("b"))
    return found.select("event_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def quadbin_distance(spark, sf_dir):
    d = quadbin.distance(quadbin.pointascell("lon", "lat", F.lit(10)), quadbin.pointascell(F.lit(-0.1), F.lit(51.5), F.lit(10)))
    return points(spark, sf_dir).select("event_id", d.alias("distance"))


def quadbin_kring(spark, sf_dir):
    return _with_cells(spark, sf_dir, 5).select("event_id", F.explode(quadbin.kring("cell", F.lit(1))).alias("cell"))


def quadbin_polyfill(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.explode(cells.quadbin_polyfill(_square("lon", "lat", 1.5), F.lit(6))).alias("cell"))


def quadbin_tessellate(spark, sf_dir):
    chips = points(spark, sf_dir).select("event_id", F.inline(cells.quadbin_tessellate(_square("lon", "lat", 1.5), F.lit(6))))
    return chips.groupBy("event_id").agg(F.round(F.sum(cells.area_of("geom")), 6).alias("area"))


def quadbin_cellunion(spark, sf_dir):
    ring = points(spark, sf_dir).select("event_id", cells.quadbin_cellunion(quadbin.kring(quadbin.pointascell("lon", "lat", F.lit(7)), F.lit(1))).alias("g"))
    return ring.select("event_id", F.round(cells.area_of("g"), 5).alias("area"))


def quadbin_cellunion_agg(spark, sf_dir):
    found = _with_cells(spark, sf_dir, 6).withColumn("k", F.col("event_id") % 97).groupBy("k").agg(cells.quadbin_cellunion_agg("cell").alias("g"))
    return found.select("k", F.round(cells.area_of("g"), 4).alias("area"))


def _square(x, y, size):
    from ..functions.wkb import box_wkb

    return box_wkb(F.col(x), F.col(y), F.col(x) + size, F.col(y) + size)


def _custom(spark, sf_dir):
    grid = custom_grid.grid(0, 1_000_000, 0, 2_000_000, 2, 1000, 1000)
    return national(spark, sf_dir).withColumn("grid", grid).withColumn("cell", custom_grid.pointascell_xy("e", "n", "grid", F.lit(3)))


def custom_pointascell(spark, sf_dir):
    from ..functions.wkb import point_wkb

    return _custom(spark, sf_dir).select("id", cells.custom_pointascell(point_wkb(F.col("e"), F.col("n")), "grid", F.lit(3)).alias("cell"))


def custom_grid_spec(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", "grid.*")


def custom_cellaswkt(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", custom_grid.cellaswkt("cell", "grid").alias("wkt"))


def custom_cellaswkb(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", cells.bounds_of(custom_grid.cellaswkb("cell", "grid")).alias("b")).select("id", "b.*")


def custom_centroid(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", cells.centroid_of(custom_grid.centroid("cell", "grid")).alias("p")).select("id", "p.*")


def custom_kring(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", F.explode(custom_grid.kring("cell", "grid", F.lit(1))).alias("cell"))


def custom_polyfill(spark, sf_dir):
    return _custom(spark, sf_dir).select("id", F.explode(cells.custom_polyfill(_square("e", "n", 2500), "grid", F.lit(0))).alias("cell"))


_CUSTOM = f"WITH p AS ({GRID_SQL}), c AS (SELECT *, floor(e / 125)::BIGINT AS cx, floor(n / 125)::BIGINT AS cy FROM p)"
_CUSTOM_ID = "(3::BIGINT << 56) | "


# British National Grid


def _bng_sql(e: str, n: str, r: int) -> str:
    if r == -1:
        return f"(CASE WHEN {e} < 500000 THEN 'S' ELSE 'T' END)"
    digits = r - 1 if r > 0 else -r - 2
    letters = f"substr('STNOHJ', ({n} // 500000 * 2 + {e} // 500000 + 1)::INT, 1) || substr('{bng._SECOND}', ((4 - {n} // 100000 % 5) * 5 + {e} // 100000 % 5 + 1)::INT, 1)"
    unit = 10 ** (5 - digits)
    number = "".join(f" || lpad(({v} % 100000 // {unit})::VARCHAR, {digits}, '0')" for v in (e, n)) if digits else ""
    half = bng.edge_of(r)
    quadrant = f" || (CASE WHEN {n} % {2 * half} >= {half} THEN 'N' ELSE 'S' END) || (CASE WHEN {e} % {2 * half} >= {half} THEN 'E' ELSE 'W' END)" if r < 0 else ""
    return f"({letters}{number}{quadrant})"


_BNG_LEVELS = (-1, 1, -2, 2, -3, 3, -4, 4, -5, 5, -6, 6)


def bng_eastnorthasbng(spark, sf_dir):
    return national(spark, sf_dir).select("id", *(bng.eastnorthasbng("e", "n", r).alias(f"cell_{k}") for k, r in enumerate(_BNG_LEVELS)))


def bng_pointascell(spark, sf_dir):
    return national(spark, sf_dir).select("id", cells.bng_pointascell(_square("e", "n", 100), "1km").alias("cell"))


def _bng(spark, sf_dir, r):
    return national(spark, sf_dir).withColumn("cell", bng.eastnorthasbng("e", "n", r))


def bng_aswkt(spark, sf_dir):
    return _bng(spark, sf_dir, 3).select("id", bng.aswkt("cell").alias("wkt"))


def bng_aswkb(spark, sf_dir):
    return _bng(spark, sf_dir, -4).select("id", cells.bounds_of(bng.aswkb("cell")).alias("b")).select("id", "b.*")


def bng_centroid(spark, sf_dir):
    return _bng(spark, sf_dir, -3).select("id", cells.centroid_of(bng.centroid("cell")).alias("p")).select("id", "p.*")


def bng_cellarea(spark, sf_dir):
    return _bng(spark, sf_dir, -2).select("id", bng.cellarea("cell").alias("area"))


def bng_distance(spark, sf_dir):
    return _bng(spark, sf_dir, 3).select("id", bng.distance("cell", F.lit("TQ3080")).alias("distance"))


def bng_euclideandistance(spark, sf_dir):
    return _bng(spark, sf_dir, 3).select("id", bng.euclideandistance("cell", F.lit("TQ3080")).alias("distance"))


def bng_kring(spark, sf_dir):
    return _bng(spark, sf_dir, 3).select("id", F.explode(bng.kring("cell", F.lit(1), 3)).alias("cell"))


def bng_kloop(spark, sf_dir):
    return _bng(spark, sf_dir, 3).select("id", F.explode(bng.kloop("cell", F.lit(2), 3)).alias("cell"))


def bng_polyfill(spark, sf_dir):
    return national(spark, sf_dir).select("id", F.explode(cells.bng_polyfill(_square("e", "n", 2500), "1km")).alias("cell"))


def _tessellated(spark, sf_dir, size=2500, keep=False):
    # By id, as the sums after it are: one exchange, and polygons spread over the cores however few files hold them.
    return national(spark, sf_dir).repartition("id").select("id", F.inline(cells.bng_tessellate(_square("e", "n", size), "1km", keep)))


def bng_tessellate(spark, sf_dir):
    return _tessellated(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_chips"), F.count_if("core").alias("n_core"), F.round(F.sum(F.coalesce(cells.area_of("chip"), F.lit(1e6))), 3).alias("area"))


def bng_geomkring(spark, sf_dir):
    return national(spark, sf_dir).select("id", F.explode(cells.bng_geomkring(_square("e", "n", 1500), "1km", F.lit(1))).alias("cell"))


def bng_geomkloop(spark, sf_dir):
    return national(spark, sf_dir).select("id", F.explode(cells.bng_geomkloop(_square("e", "n", 1500), "1km", 1)).alias("cell"))


def _chip_pairs(spark, sf_dir):
    inner = national(spark, sf_dir).repartition("id")
    pair = inner.select("id", "e", "n", F.inline(cells.bng_tessellate(_square("e", "n", 700), "1km"))).select("id", F.struct("cellid", "core", "chip").alias("a"))
    other = inner.select("id", "e", "n", F.inline(cells.bng_tessellate(_square("e", "n", 400), "1km"))).select("id", F.struct("cellid", "core", "chip").alias("b"))
    return pair.join(other, (pair["id"] == other["id"]) & (F.col("a.cellid") == F.col("b.cellid"))).select(pair["id"], "a", "b")


def bng_cellintersection(spark, sf_dir):
    return _chip_pairs(spark, sf_dir).select("id", cells.bng_cellintersection("a", "b").alias("c")).groupBy("id").agg(F.round(F.sum(cells.area_of("c.chip")), 3).alias("area"))


def bng_cellunion(spark, sf_dir):
    return _chip_pairs(spark, sf_dir).select("id", cells.bng_cellunion("a", "b").alias("c")).groupBy("id").agg(F.round(F.sum(cells.area_of("c.chip")), 3).alias("area"))


def _chip_groups(spark, sf_dir, aggregate):
    both = _chip_pairs(spark, sf_dir).select("id", F.explode(F.array("a", "b")).alias("chip"))
    made = both.groupBy("id", F.col("chip.cellid").alias("cellid")).agg(aggregate("chip").alias("g"))
    return made.select("id", "cellid", F.round(cells.area_of("g"), 3).alias("area")).groupBy("id").agg(F.round(F.sum("area"), 2).alias("area"))


def bng_cellintersection_agg(spark, sf_dir):
    return _chip_groups(spark, sf_dir, cells.bng_cellintersection_agg)


def bng_cellunion_agg(spark, sf_dir):
    return _chip_groups(spark, sf_dir, cells.bng_cellunion_agg)


def spatial_join(spark, sf_dir):
    """Points in a 5 km square at every order, by cell equi-join and refinement."""
    from ..operators.spatial_join import points_in_polygons

    # By id, so that zones are cut on all cores however few files hold them.
    zones = national(spark, sf_dir).repartition("id").select(F.col("id").alias("zone_id"), _square("e", "n", 5000).alias("geom"))
    return points_in_polygons(national(spark, sf_dir), zones, "5km").groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_points"))


def _tile_x(lon: str) -> str:
    return f"least(63, greatest(0, floor(({lon} + 180) / 360 * 64)))::BIGINT"


def _tile_y(lat: str) -> str:
    s = f"sin(radians(least(85.05112878, greatest(-85.05112878, {lat}))))"
    return f"least(63, greatest(0, floor((0.5 - ln((1 + {s}) / (1 - {s})) / (4 * pi())) * 64)))::BIGINT"


def _text(v: str) -> str:
    """Spark's text of a coordinate of up to 7 digits before the point; larger ones turn to powers of ten there."""
    plain = f"regexp_replace(format('{{:.3f}}', {v}), '(\\.[0-9]*?)0+$', '\\1')"
    small = f"(CASE WHEN {plain} LIKE '%.' THEN {plain} || '0' ELSE {plain} END)"
    return small


_RING = "range(-1, 2)"
_AT_LEAST_0 = "x2 >= 0 AND y2 >= 0 AND x2 < 800000 AND y2 < 1400000"
_SQUARE_CELLS = f"WITH p AS ({GRID_SQL}), i AS (SELECT * FROM p, range(0, 4) a(i), range(0, 4) b(j))"


def oracle_sql() -> dict[str, str]:
    bounds = "x / {n} * 360 - 180 AS west, (x + 1) / {n} * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / {n})))) AS south, degrees(atan(sinh(pi() * (1 - 2 * y / {n})))) AS north"
    b8 = bounds.format(n="256.0::DOUBLE")
    london = "SELECT floor((-0.1::DOUBLE + 180) / 360 * 1024)::BIGINT AS lx, floor((0.5 - ln((1 + sin(radians(51.5))) / (1 - sin(radians(51.5)))) / (4 * pi())) * 1024)::BIGINT AS ly"
    cell_of = lambda x, y, z: f"{quadbin._HEADER} | ({z}::BIGINT << 52) | {_spread_sql(f'({x} << {26 - z})')} | ({_spread_sql(f'({y} << {26 - z})')} << 1) | {((1 << 52) - 1) >> (2 * z)}"
    kring = lambda low, high, skip: f"WITH p AS ({GRID_SQL}), q AS (SELECT id, e // 1000 * 1000 + dx * 1000 AS x2, n // 1000 * 1000 + dy * 1000 AS y2 FROM p, range({low}, {high}) a(dx), range({low}, {high}) b(dy) WHERE {skip}) SELECT id, {_bng_sql('x2', 'y2', 3)} AS cell FROM q WHERE {_AT_LEAST_0}"
    covered = "((e + {s} - 1) // 1000 - e // 1000 + 1)"
    grown = lambda lo, hi, where, skip="": f"WITH p AS ({GRID_SQL}), q AS (SELECT id, x * 1000 AS x2, y * 1000 AS y2 FROM p, range(-1, 5) a(dx), range(-1, 5) b(dy), LATERAL (SELECT e // 1000 + dx AS x, n // 1000 + dy AS y, (e + 1500 - 1) // 1000 AS ex, (n + 1500 - 1) // 1000 AS ny) WHERE {where} AND x <= ex + 1 AND y <= ny + 1 {skip}) SELECT id, {_bng_sql('x2', 'y2', 3)} AS cell FROM q WHERE {_AT_LEAST_0}"
    wide = lambda low, high, skip: f"WITH p AS ({GRID_SQL}), q AS (SELECT id, e // 10000 * 10000 + dx * 10000 AS x2, n // 10000 * 10000 + dy * 10000 AS y2 FROM p, range({low}, {high}) a(dx), range({low}, {high}) b(dy) WHERE {skip}) SELECT id, {_bng_sql('x2', 'y2', 2)} AS cell FROM q WHERE {_AT_LEAST_0}"
    widely = lambda skip: f"WITH p AS ({GRID_SQL}), q AS (SELECT id, x * 10000 AS x2, y * 10000 AS y2 FROM p, range(-1, 5) a(dx), range(-1, 5) b(dy), LATERAL (SELECT e // 10000 + dx AS x, n // 10000 + dy AS y, (e + 15000 - 1) // 10000 AS ex, (n + 15000 - 1) // 10000 AS ny) WHERE x <= ex + 1 AND y <= ny + 1 AND {skip}) SELECT id, {_bng_sql('x2', 'y2', 2)} AS cell FROM q WHERE {_AT_LEAST_0}"
    # Cells of 1 km that a square of 400 m touches, whose union with the square of 700 m there is the larger one's part.
    part = lambda v: f"(CASE WHEN {v} % 1000 + 400 > 1000 THEN 700 ELSE least(700, 1000 - {v} % 1000) END)"
    overlap = f"{part('e')} * {part('n')}"
    return {
        "events_by_cell": f"{_point_cte(6)} SELECT cell, count(*) AS n_events, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value FROM c GROUP BY cell ORDER BY n_events DESC, cell LIMIT 10",
        "quadbin_pointascell": f"{_point_cte(14)} SELECT event_id, cell FROM c",
        "quadbin_resolution": f"{_point_cte(9)} SELECT event_id, ((cell >> 52) & 31)::INT AS resolution FROM c",
        "quadbin_centroid": f"{_point_cte(8)}, b AS (SELECT event_id, {b8} FROM c) SELECT event_id, round((west + east) / 2, 6) AS lon, round((south + north) / 2, 6) AS lat FROM b",
        "quadbin_aswkb": f"{_point_cte(8)}, b AS (SELECT event_id, {b8} FROM c) SELECT event_id, round(west, 6) AS xmin, round(south, 6) AS ymin, round(east, 6) AS xmax, round(north, 6) AS ymax FROM b",
        "quadbin_distance": f"{_point_cte(10)}, l AS ({london}) SELECT event_id, greatest(abs(x - lx), abs(y - ly))::INT AS distance FROM c, l",
        "quadbin_kring": f"{_point_cte(5)}, k AS (SELECT event_id, x + dx AS x, y + dy AS y FROM t, range(-1, 2) a(dx), range(-1, 2) b(dy)) SELECT event_id, {cell_of('x', 'y', 5)} AS cell FROM k WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31",
        "quadbin_tessellate": f"WITH p AS ({POINTS_SQL}) SELECT event_id, round((least(lon + 1.5, 180) - lon) * (least(lat + 1.5, 85.05112877980659::DOUBLE) - lat), 6) AS area FROM p",
        "quadbin_cellunion": f"{_point_cte(7)}, b AS (SELECT event_id, (least(x + 2, 128) - greatest(x - 1, 0)) * 360 / 128.0::DOUBLE AS w, degrees(atan(sinh(pi() * (1 - 2 * greatest(y - 1, 0) / 128.0::DOUBLE)))) - degrees(atan(sinh(pi() * (1 - 2 * least(y + 2, 128) / 128.0::DOUBLE)))) AS h FROM c) SELECT event_id, round(w * h, 5) AS area FROM b",
        "quadbin_cellunion_agg": f"{_point_cte(6)}, d AS (SELECT DISTINCT event_id % 97 AS k, x, y FROM c) SELECT k, round(sum(360 / 64.0::DOUBLE * (degrees(atan(sinh(pi() * (1 - 2 * y / 64.0::DOUBLE)))) - degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 64.0::DOUBLE)))))), 4) AS area FROM d GROUP BY k",
        "custom_grid": f"WITH p AS ({GRID_SQL}) SELECT id, 0::BIGINT AS bound_x_min, 1000000::BIGINT AS bound_x_max, 0::BIGINT AS bound_y_min, 2000000::BIGINT AS bound_y_max, 2::INT AS cell_splits, 1000::INT AS root_cell_size_x, 1000::INT AS root_cell_size_y, -1::INT AS srid FROM p",
        "custom_pointascell": f"{_CUSTOM} SELECT id, {_CUSTOM_ID} (cy * 8000 + cx) AS cell FROM c",
        "custom_cellaswkb": f"{_CUSTOM} SELECT id, cx * 125.0::DOUBLE AS xmin, cy * 125.0::DOUBLE AS ymin, (cx + 1) * 125.0::DOUBLE AS xmax, (cy + 1) * 125.0::DOUBLE AS ymax FROM c",
        "custom_centroid": f"{_CUSTOM} SELECT id, cx * 125.0::DOUBLE + 62.5 AS x, cy * 125.0::DOUBLE + 62.5 AS y FROM c",
        "custom_kring": f"{_CUSTOM} SELECT id, {_CUSTOM_ID} ((cy + dy) * 8000 + cx + dx) AS cell FROM c, {_RING} a(dx), {_RING} b(dy) WHERE cx + dx BETWEEN 0 AND 8000 AND cy + dy BETWEEN 0 AND 16000",
        "custom_polyfill": f"{_SQUARE_CELLS} SELECT id, (n // 1000 + j) * 1000 + e // 1000 + i AS cell FROM i WHERE (e // 1000 + i) * 1000 + 500 >= e AND (e // 1000 + i) * 1000 + 500 < e + 2500 AND (n // 1000 + j) * 1000 + 500 >= n AND (n // 1000 + j) * 1000 + 500 < n + 2500",
        "bng_eastnorthasbng": f"WITH p AS ({GRID_SQL}) SELECT id, " + ", ".join(f"{_bng_sql('e', 'n', r)} AS cell_{k}" for k, r in enumerate(_BNG_LEVELS)) + " FROM p",
        "bng_pointascell": f"WITH p AS (SELECT id, e + 50 AS e, n + 50 AS n FROM ({GRID_SQL})) SELECT id, {_bng_sql('e', 'n', 3)} AS cell FROM p",
        "bng_aswkt": f"WITH p AS (SELECT id, e // 1000 * 1000 AS x, n // 1000 * 1000 AS y FROM ({GRID_SQL})) SELECT id, format('POLYGON (({{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}, {{}} {{}}))', x + 1000, y, x + 1000, y + 1000, x, y + 1000, x, y, x + 1000, y) AS wkt FROM p",
        "bng_aswkb": f"WITH p AS (SELECT id, e // 500 * 500.0::DOUBLE AS x, n // 500 * 500.0::DOUBLE AS y FROM ({GRID_SQL})) SELECT id, x AS xmin, y AS ymin, x + 500 AS xmax, y + 500 AS ymax FROM p",
        "bng_centroid": f"WITH p AS ({GRID_SQL}) SELECT id, e // 5000 * 5000.0::DOUBLE + 2500 AS x, n // 5000 * 5000.0::DOUBLE + 2500 AS y FROM p",
        "bng_cellarea": f"WITH p AS ({GRID_SQL}) SELECT id, 2500.0::DOUBLE AS area FROM p",
        "bng_distance": f"WITH p AS ({GRID_SQL}) SELECT id, abs(e // 1000 - 530) + abs(n // 1000 - 180) AS distance FROM p",
        "bng_euclideandistance": f"WITH p AS ({GRID_SQL}) SELECT id, greatest(abs(e // 1000 - 530), abs(n // 1000 - 180)) AS distance FROM p",
        "bng_kring": kring(-1, 2, "TRUE"),
        "bng_kloop": kring(-2, 3, "greatest(abs(dx), abs(dy)) = 2"),
        "bng_polyfill": f"{_SQUARE_CELLS}, q AS (SELECT id, e, n, (e // 1000 + i) * 1000 AS x2, (n // 1000 + j) * 1000 AS y2 FROM i) SELECT id, {_bng_sql('x2', 'y2', 3)} AS cell FROM q WHERE x2 + 500 >= e AND x2 + 500 < e + 2500 AND y2 + 500 >= n AND y2 + 500 < n + 2500",
        "bng_tessellate": f"WITH p AS ({GRID_SQL}) SELECT id, {covered.format(s=2500)} * ((n + 2499) // 1000 - n // 1000 + 1) AS n_chips, ((e + 2500) // 1000 - (e + 999) // 1000) * ((n + 2500) // 1000 - (n + 999) // 1000) AS n_core, 6250000.0::DOUBLE AS area FROM p",
        "bng_geomkring": grown(-1, 2, "TRUE"),
        "bng_geomkloop": grown(-1, 2, "TRUE", "AND NOT (x BETWEEN e // 1000 AND ex AND y BETWEEN n // 1000 AND ny)"),
        "bng_cellintersection": f"WITH p AS ({GRID_SQL}) SELECT id, 160000.0::DOUBLE AS area FROM p",
        "bng_cellintersection_agg": f"WITH p AS ({GRID_SQL}) SELECT id, 160000.0::DOUBLE AS area FROM p",
        "quadbin_polyfill": f"""WITH p AS ({POINTS_SQL}), b AS (SELECT event_id, {_tile_x('lon')} AS x0, {_tile_x('lon + 1.5')} AS x1, {_tile_y('lat + 1.5')} AS y0, {_tile_y('lat')} AS y1 FROM p)
SELECT event_id, {cell_of('(x0 + dx)', '(y0 + dy)', 6)} AS cell FROM b, range(0, 3) a(dx), range(0, 24) c(dy) WHERE x0 + dx <= x1 AND y0 + dy <= y1""",
        "bng_kringexplode": wide(-2, 3, "TRUE"),
        "bng_kloopexplode": wide(-1, 2, "greatest(abs(dx), abs(dy)) = 1"),
        "bng_geomkringexplode": widely("TRUE"),
        "bng_geomkloopexplode": widely("NOT (x BETWEEN e // 10000 AND ex AND y BETWEEN n // 10000 AND ny)"),
        "bng_tessellateexplode": f"""{_SQUARE_CELLS}, q AS (SELECT id, (e // 1000 + i) * 1000 AS x2, (n // 1000 + j) * 1000 AS y2, e, n FROM i),
r AS (SELECT *, least(e + 2500, x2 + 1000) - greatest(e, x2) AS w, least(n + 2500, y2 + 1000) - greatest(n, y2) AS h FROM q)
SELECT id, {_bng_sql('x2', 'y2', 3)} AS cellid, w = 1000 AND h = 1000 AS core, round(w * h::DOUBLE, 3) AS area FROM r WHERE w > 0 AND h > 0""",
        "bng_cellunion": f"""WITH p AS ({GRID_SQL}) SELECT id, {overlap}::DOUBLE AS area FROM p""",
        "bng_cellunion_agg": f"""WITH p AS ({GRID_SQL}) SELECT id, {overlap}::DOUBLE AS area FROM p""",
        "custom_cellaswkt": f"""{_CUSTOM}, b AS (SELECT id, cx * 125.0::DOUBLE AS a, cy * 125.0::DOUBLE AS b, (cx + 1) * 125.0::DOUBLE AS c, (cy + 1) * 125.0::DOUBLE AS d FROM c)
SELECT id, 'POLYGON ((' || {_text('c')} || ' ' || {_text('b')} || ', ' || {_text('c')} || ' ' || {_text('d')} || ', ' || {_text('a')} || ' ' || {_text('d')} || ', ' || {_text('a')} || ' ' || {_text('b')} || ', ' || {_text('c')} || ' ' || {_text('b')} || '))' AS wkt FROM b""",
        "spatial_join": f"WITH p AS ({GRID_SQL}), z AS (SELECT * FROM p) SELECT z.id AS zone_id, count(*) AS n_points FROM z JOIN p ON p.e >= z.e AND p.e < z.e + 5000 AND p.n >= z.n AND p.n < z.n + 5000 GROUP BY z.id",
    }


def bng_kringexplode(spark, sf_dir):
    return _bng(spark, sf_dir, 2).select("id", F.explode(bng.kring("cell", F.lit(2), 2)).alias("cell"))


def bng_kloopexplode(spark, sf_dir):
    return _bng(spark, sf_dir, 2).select("id", F.explode(bng.kloop("cell", F.lit(1), 2)).alias("cell"))


def bng_geomkringexplode(spark, sf_dir):
    return national(spark, sf_dir).select("id", F.explode(cells.bng_geomkring(_square("e", "n", 15_000), "10km", F.lit(1))).alias("cell"))


def bng_geomkloopexplode(spark, sf_dir):
    return national(spark, sf_dir).select("id", F.explode(cells.bng_geomkloop(_square("e", "n", 15_000), "10km", 1)).alias("cell"))


def bng_tessellateexplode(spark, sf_dir):
    chips = national(spark, sf_dir).select("id", cells.bng_tessellateexplode(_square("e", "n", 2500), "1km"))
    return chips.select("id", "cellid", "core", F.round(F.coalesce(cells.area_of("chip"), F.lit(1e6)), 3).alias("area"))


def queries() -> dict:
    names = [n for n in globals() if n.startswith(("quadbin_", "bng_", "custom_")) and n not in ("custom_grid", "custom_grid_spec")]
    found = {n: globals()[n] for n in ["events_by_cell", *names, "spatial_join"]}
    return found | {"custom_grid": custom_grid_spec}
