"""Queries read whole tables: rows that filters once left out, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from groundweave.plans import registry


def table(sf_dir, name, *columns):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet", columns=list(columns))


def test_pyramid_of_all_events(spark, sf_dir):
    events = table(sf_dir, "events", "event_id", "user_id")
    lon, lat = (events.user_id * 37 % 36000) / 100.0 - 180, (events.event_id * 53 % 17000) / 100.0 - 85
    mercator = lambda v: 0.5 - math.asinh(math.tan(math.radians(min(max(v, -85.05112878), 85.05112878)))) / (2 * math.pi)
    want, edge = set(), set()
    for i, x, y in zip(events.event_id, lon, lat, strict=True):
        for z in (3, 4, 5):
            n = 2**z
            a, b, c, d = (x + 180) / 360 * n, min((x + 180.5) / 360, 1.0) * n, max(mercator(y + 0.5), 0.0) * n, mercator(y) * n
            if any(abs(v - round(v)) < 1e-6 and 0 < round(v) < n for v in (a, b, c, d)):
                edge.add(i)  # on a tile's border
            want |= {(i, z, p, q) for p in range(int(a), math.ceil(b - 1e-9)) for q in range(int(c), math.ceil(d - 1e-9))}
    got = registry.queries()["st_asmvt_pyramid"](spark, sf_dir).toPandas()
    found = set(map(tuple, got[["event_id", "z", "x", "y"]].to_numpy().tolist()))
    assert len(edge) < len(events) / 10
    assert {t for t in found if t[0] not in edge} == {t for t in want if t[0] not in edge}
    assert set(got.event_id) == set(events.event_id)


def test_sites_of_all_orders(spark, sf_dir):
    from groundweave.plans.vector_queries import _sites

    o = table(sf_dir, "orders", "o_orderkey", "o_custkey")
    k, x, y = o.o_orderkey % 20, o.o_orderkey * 97 % 700000 % 97 + 1, o.o_custkey * 131 % 1300000 % 89 + 1
    want = set(zip(k, x, y, strict=True)) | {(g, a, b) for g in set(k) for a, b in ((0, 0), (100, 0), (100, 100), (0, 100))}
    got = _sites(spark, sf_dir).toPandas()
    assert {g: len(set(ps)) for g, ps in zip(got.k, got.ps, strict=True)} == {g: sum(w[0] == g for w in want) for g in set(k)}


def test_rasters_of_all_tiles(spark, sf_dir):
    x = table(sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")
    p = pd.DataFrame({"tile_id": x.l_suppkey % 16, "row": x.l_orderkey % 64, "col": x.l_partkey % 64, "value": x.l_extendedprice}).groupby(["tile_id", "row", "col"], as_index=False).value.max()
    ids = sorted(set(p.tile_id))
    q = registry.queries()
    assert set(q["rst_xyzpyramid"](spark, sf_dir).toPandas().tile_id) == set(ids)
    following = p.assign(tile_id=p.tile_id.map(dict(zip(ids[1:] + ids[:1], ids, strict=True))))
    want = p.merge(following, on=["tile_id", "row", "col"])
    got = q["rst_mapalgebra"](spark, sf_dir).toPandas().merge(want, on=["tile_id", "row", "col"])
    assert len(got) == len(want) == q["rst_mapalgebra"](spark, sf_dir).count() and np.allclose(got.value, (got.value_x + got.value_y) / 2, rtol=1e-6)
    grid = q["rst_gridfrompoints_agg"](spark, sf_dir).toPandas()
    assert len(grid) == 256 * len(ids)
    for t, part in p.groupby("tile_id"):
        mine = grid[grid.tile_id == t]
        d = np.hypot((mine.col.to_numpy() * 4 + 2)[:, None] - (part.col.to_numpy() + 0.5), (64 - mine.row.to_numpy() * 4 - 2)[:, None] - (part.row.to_numpy() + 0.5))
        d = np.sort(d, axis=1)
        # The twelve nearest points bound the mean; ties at the twelfth may go either way.
        assert mine.value.between(part.value.min(), part.value.max()).all() and (d[:, 0] > 0).all()
