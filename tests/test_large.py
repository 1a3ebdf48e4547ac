"""What failed on larger tables: each test fails, or takes far too long, with the code before."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from groundweave.functions import geometry
from groundweave.vector import tiles


def test_legacy_polygons_without_holes_of_many_batches(spark):
    ring = F.array(*(F.array(F.col("id") + a, F.lit(b)) for a, b in ((0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0), (0.0, 0.0))))
    old = F.struct(F.lit(3).alias("typeId"), F.lit(0).alias("srid"), F.array(ring).alias("boundaries"), F.lit(None).cast("array<array<array<array<double>>>>").alias("holes"))
    found = spark.range(0, 300_000, 1, 2).select("id", tiles.legacyaswkb(old).alias("g")).toPandas()
    assert len(found) == 300_000
    assert all(geometry.parse(g).bounds() == (i, 0.0, i + 3, 2.0) for i, g in found.sample(500, random_state=1).itertuples(index=False))
    assert found.g.str.len().eq(93).all()


def test_legacy_kinds_holes_and_nulls_side_by_side(spark):
    square = lambda a, b, *z: [[a, a, *z], [b, a, *z], [b, b, *z], [a, b, *z], [a, a, *z]]
    rows = [
        (0, 3, [square(0.0, 9.0)], None),
        (1, 3, [square(0.0, 9.0)], [[square(1.0, 2.0), square(3.0, 4.0)]]),
        (2, 3, [square(0.0, 9.0, 5.0)], [[]]),
        (3, 6, [square(0.0, 9.0), square(10.0, 20.0)], [[], [square(11.0, 12.0)]]),
        (4, 1, [[[1.0, 2.0, 3.0]]], []),
        (5, 3, None, None),
        (6, 5, [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0], [4.0, 4.0]]], None),
    ]
    schema = "id int, g struct<typeId: int, boundaries: array<array<array<double>>>, holes: array<array<array<array<double>>>>>"
    for some in (rows, rows[:1], rows[5:6]):
        frame = spark.createDataFrame([(i, (k, b, h)) for i, k, b, h in some], schema).coalesce(1)
        got = dict(frame.select("id", tiles.legacyaswkb("g")).collect())
        for i, kind, boundaries, holes in some:
            if boundaries is None:
                assert got[i] is None
                continue
            g = geometry.parse(got[i])
            inner = [[np.array(h) for h in hs] for hs in holes or []]
            shells = [np.array(b) for b in boundaries]
            want = [[s, *(inner[k] if k < len(inner) else [])] for k, s in enumerate(shells)] if kind in (3, 6) else shells
            assert g.kind == kind and len(g.parts) == len(want)
            for a, b in zip(g.parts, want, strict=True):
                pairs = list(zip(a, b, strict=True)) if kind in (3, 6) else [(a, b)]
                assert all(np.array_equal(x, y) for x, y in pairs)


def test_triangles_of_many_points_take_no_square_of_time():
    """About a minute before; the surface is a plane, and triangles fill the square."""
    from groundweave.vector import tin

    some = np.random.default_rng(5)
    xy = np.unique(np.vstack([some.integers(1, [98, 90], (12_000, 2)), [[0, 0], [100, 0], [100, 100], [0, 100]]]), axis=0).astype(float)
    points = np.column_stack([xy, 2 * xy[:, 0] + 3 * xy[:, 1]])
    start = time.process_time()
    found = tin.delaunay(points)
    assert time.process_time() - start < 20
    a, b, c = (xy[found[:, k]] for k in range(3))
    size = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    assert (size > 0).all() and size.sum() == 10_000 and len(np.unique(found)) == len(points)
    x, y = (v.ravel() for v in np.meshgrid(np.arange(0.5, 100), np.arange(0.5, 100)))
    assert np.allclose(tin.heights(points, found, x, y), 2 * x + 3 * y, atol=1e-9)


def test_spatial_join_of_any_polygons_without_python_by_pair(spark):
    """Upright squares and others, corners and borders included; pairs never leave the JVM, as they did before."""
    from groundweave.operators.spatial_join import points_in_polygons

    some = np.random.default_rng(2)
    rings = [[(1000, 1000), (6000, 1000), (6000, 6000), (1000, 6000)], [(500, 500), (9500, 2500), (7500, 9500), (3000, 4000)], [(2000, 0), (4000, 2000), (2000, 4000), (0, 2000)], [(3000, 3000), (3000, 3500), (3500, 3500), (3500, 3000)]]
    hole = [(2000, 2000), (2500, 4500), (4500, 4500), (4500, 2000)]
    shapes = [geometry.Geometry(3, [[np.array([*r, r[0]], float)]]) for r in rings] + [geometry.Geometry(3, [[np.array([*r, r[0]], float) for r in (rings[0], hole)]])]
    at = np.concatenate([some.integers(0, 10_000, (1500, 2)), some.integers(0, 21, (1500, 2)) * 500, np.array([p for r in rings for p in r])])
    points = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(at)], "k long, e long, n long")
    zones = spark.createDataFrame([(z, bytearray(geometry.to_wkb(g))) for z, g in enumerate(shapes)], "z int, geom binary")
    joined = points_in_polygons(points, zones, "1km")
    assert sorted(joined.columns) == ["e", "k", "n", "z"]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Python" not in plan[: plan.index("Join")] and "holds" not in plan
    got = sorted(map(tuple, joined.select("z", "k").collect()))
    want = sorted((z, int(k)) for z, g in enumerate(shapes) for k in np.flatnonzero(geometry.contains(g, at[:, 0].astype(float), at[:, 1].astype(float))))
    # Slanted sides are cut at cells, so points on them may fall to either side; squares' must agree throughout.
    edge = {(z, k) for z in (1, 2, 4) for k, (a, b) in enumerate(at) for p, q in zip(rings[z] if z < 4 else hole, (rings[z] if z < 4 else hole)[1:] + (rings[z] if z < 4 else hole)[:1], strict=True) if abs((q[0] - p[0]) * (b - p[1]) - (q[1] - p[1]) * (a - p[0])) < 1e-6}
    assert len(got) == len(set(got)) and set(got) ^ set(want) <= edge
    assert [p for p in got if p[0] in (0, 3)] == [p for p in want if p[0] in (0, 3)]


def test_groups_of_chips_fold_in_batches_as_one_by_one(spark):
    """No call of Python by group, as there was before; rectangles, others, whole cells and mixed cells give what overlay gives."""
    from groundweave.functions import cells

    some = np.random.default_rng(4)
    box = lambda a, b, c, d: geometry.to_wkb(geometry.box(a, b, c, d))
    slanted = geometry.to_wkb(geometry.Geometry(3, [[np.array([(530000, 180000), (530900, 180100), (530400, 180800), (530000, 180000)], float)]]))
    rectangles = lambda: ((min(a, c), min(b, d), max(a, c) + 1, max(b, d) + 1) for a, b, c, d in some.integers(0, 1000, (3, 4)).tolist())
    groups = [[(False, box(530000 + a, 180000 + b, 530000 + c, 180000 + d)) for a, b, c, d in rectangles()] for _ in range(40)]
    groups += [[(False, box(530000, 180000, 530700, 180700)), (False, box(530000, 180000, 530400, 180400))], [(False, slanted), (False, box(530000, 180000, 530700, 180300))]]
    groups += [[(True, None), (False, slanted)], [(True, None)], [(False, None), (None, box(530000, 180000, 530100, 180100))], [(False, box(530000, 180000, 530100, 180100)), (False, box(530100, 180000, 530200, 180100))]]
    rows = [(k, ("TQ3080", core, None if g is None else bytearray(g))) for k, group in enumerate(groups) for core, g in group]
    schema = "k int, chip struct<cellid: string, core: boolean, chip: binary>"
    frame = spark.createDataFrame(rows, schema)
    whole = geometry.box(530000, 180000, 531000, 181000)
    for aggregate, operation, core_wins in ((cells.bng_cellintersection_agg, geometry.intersection, False), (cells.bng_cellunion_agg, geometry.union, True)):
        made = frame.groupBy("k").agg(aggregate("chip").alias("g"))
        assert "ArrowAggregatePython" not in made._jdf.queryExecution().executedPlan().toString() and "AggregateInPandas" not in made._jdf.queryExecution().executedPlan().toString()
        got = dict(made.collect())
        for k, group in enumerate(groups):
            borders = [geometry.parse(g) for core, g in group if not core and g is not None]
            want = whole if not borders or core_wins and any(c for c, _ in group) else operation(borders)
            found = geometry.parse(got[k])
            assert abs(geometry.area(found) - geometry.area(want)) < 1e-6 and found.bounds() == want.bounds(), k
    mixed = spark.createDataFrame([(0, ("TQ3080", True, None)), (0, ("TQ3081", True, None))], schema)
    assert geometry.parse(mixed.groupBy("k").agg(cells.bng_cellunion_agg("chip").alias("g")).first().g).bounds() is None


def test_small_ranges_of_lines_share_tasks(spark, tmp_path):
    """A task by range of 50 bytes before, over two thousand of them; each line is still read once."""
    from groundweave.sources import formats

    formats.register_formats(spark)
    (tmp_path / "a.geojsonl").write_text("".join('{"type":"Feature","properties":{"k":%d},"geometry":{"type":"Point","coordinates":[%d,1]}}\n' % (k, k % 90) for k in range(1200)))
    found = spark.read.format("gw_geojsonl").option("splitBytes", "50").load(str(tmp_path))
    source = formats.GeoJSONLines({"path": str(tmp_path), "splitBytes": "50"})
    assert len(source.parts()) > 1500
    tasks = source.reader(found.schema).partitions()
    assert len(tasks) <= formats.MAX_TASKS and [(p.source, p.start, p.end) for t in tasks for p in t.parts] == [(p.source, p.start, p.end) for p in source.parts()]
    assert sorted(r.k for r in found.collect()) == list(range(1200))
