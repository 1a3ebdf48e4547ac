"""Terrain surfaces: Delaunay triangles of Z points, and heights interpolated in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..functions.wkb import col
from ..raster.codec import encode
from ..raster.functions import as_tile
from ..raster.kernels import blank


def merged(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points without those that lie within the tolerance of an earlier one."""
    kept: list[np.ndarray] = []
    seen: dict[tuple[int, int], list[int]] = {}
    size = max(tolerance, 1e-12)
    for p in points:
        cell = (int(np.floor(p[0] / size)), int(np.floor(p[1] / size)))
        near = (k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in seen.get((cell[0] + i, cell[1] + j), ()))
        if all(np.hypot(*(kept[k][:2] - p[:2])) > tolerance for k in near):
            seen.setdefault(cell, []).append(len(kept))
            kept.append(p)
    return np.array(kept).reshape(-1, points.shape[1] if len(points) else 3)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles as rows of point numbers, counter-clockwise, by adding points one at a time, from left to right.

    A triangle whose circle lies left of a point stays as it is from then on, so that only those near the last points are tested.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    xy = points[:, :2] - points[:, :2].mean(axis=0)
    span = max(float(np.abs(xy).max()), 1e-9) * 1e4
    p = np.vstack([xy, [[-span, -span], [span, -span], [0, span]]])
    triangles = np.array([(n, n + 1, n + 2)])
    circles, found = _circles(p, triangles), []
    for i in np.lexsort((xy[:, 1], xy[:, 0])).tolist():
        x, y = p[i].tolist()
        across, most = (x - circles[:, 0]) ** 2, circles[:, 2] * (1 + 1e-12)
        bad = across + (y - circles[:, 1]) ** 2 < most
        past = (x > circles[:, 0]) & (across >= most)
        edges = triangles[bad][:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
        key = edges.min(axis=1) * len(p) + edges.max(axis=1)
        order = key.argsort()
        key = key[order]
        same = key[1:] == key[:-1]  # an edge inside the hole comes twice
        alone = np.ones(len(key), dtype=bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        edges = edges[order[alone]]
        (ax, ay), (bx, by) = p[edges[:, 0]].T, p[edges[:, 1]].T
        edges = edges[(bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0]
        new = np.column_stack([edges, np.full(len(edges), i)])
        found.append(triangles[past])
        left = ~(bad | past)
        triangles, circles = np.concatenate([triangles[left], new]), np.concatenate([circles[left], _circles(p, new)])
    made = np.concatenate([*found, triangles])
    return np.array(sorted(made[made.max(axis=1) < n].tolist()), int).reshape(-1, 3)


def _circles(p: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """(x, y, squared radius) of the circle through each triangle's corners; without end where they lie on one line."""
    (ax, ay), (bx, by), (cx, cy) = (p[triangles[:, k]].T for k in range(3))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b, c = ax**2 + ay**2, bx**2 + by**2, cx**2 + cy**2
        x = (a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d
        y = (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d
    x, y = np.where(d == 0, ax, x), np.where(d == 0, ay, y)
    return np.stack([x, y, np.where(d == 0, np.inf, (ax - x) ** 2 + (ay - y) ** 2)], axis=1)


def constrained(points: np.ndarray, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(points, triangles) in which every line runs along edges: lines are halved where an edge is missing, which adds points on them."""
    segments = []
    for line in lines:
        at = []
        for q in line:
            near = np.flatnonzero(np.hypot(*(points[:, :2] - q[:2]).T) == 0) if len(points) else []
            if not len(near):
                points = np.vstack([points, q])
                near = [len(points) - 1]
            at.append(int(near[0]))
        segments += list(zip(at[:-1], at[1:], strict=True))
    for _ in range(20):
        triangles = delaunay(points)
        edges = {tuple(sorted(e)) for a, b, c in triangles.tolist() for e in ((a, b), (b, c), (c, a))}
        missing = [s for s in segments if tuple(sorted(s)) not in edges]
        if not missing:
            break
        for a, b in missing:
            points = np.vstack([points, (points[a] + points[b]) / 2])
            segments.remove((a, b))
            segments += [(a, len(points) - 1), (len(points) - 1, b)]
    return points, triangles


def heights(points: np.ndarray, triangles: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Z at each place by its triangle's plane; NaN outside the hull."""
    out = np.full(len(x), np.nan)
    if not len(triangles):
        return out
    # Places by x: a triangle looks at those of its own stretch, in the places' order, and most have none.
    order = np.argsort(x, kind="stable")
    corners = points[triangles][:, :, :3]
    first, last = np.searchsorted(x[order], corners[:, :, 0].min(axis=1)), np.searchsorted(x[order], corners[:, :, 0].max(axis=1), "right")
    for k in np.flatnonzero(first < last).tolist():
        (a, b, c), mine = corners[k], order[first[k] : last[k]]
        d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
        if d == 0:
            continue
        near = mine[(y[mine] >= min(a[1], b[1], c[1])) & (y[mine] <= max(a[1], b[1], c[1])) & np.isnan(out[mine])]
        u = ((b[1] - c[1]) * (x[near] - c[0]) + (c[0] - b[0]) * (y[near] - c[1])) / d
        v = ((c[1] - a[1]) * (x[near] - c[0]) + (a[0] - c[0]) * (y[near] - c[1])) / d
        w = 1 - u - v
        ok = (u >= -1e-9) & (v >= -1e-9) & (w >= -1e-9)
        out[near[ok]] = (u * a[2] + v * b[2] + w * c[2])[ok]
    return out


def _surface(points, lines, tolerance):
    p = [geometry.parse(g).coordinates() for g in points if g is not None] if points is not None else []
    p = np.vstack([np.hstack([c, np.zeros((len(c), 3 - c.shape[1]))])[:, :3] for c in p]) if p else np.zeros((0, 3))
    b = [np.hstack([c, np.zeros((len(c), 3 - c.shape[1]))])[:, :3] for g in (lines if lines is not None else []) if g is not None for c in geometry.parse(g).parts]
    p = merged(p, float(tolerance or 0))
    return constrained(p, b) if b else (p, delaunay(p))


def _udf(f, kind):
    @F.pandas_udf(kind)
    def run(points: pd.Series, lines: pd.Series, tolerance: pd.Series) -> pd.Series:
        return pd.Series([f(*_surface(p, b, t)) for p, b, t in zip(points, lines, tolerance, strict=True)], dtype=object)

    return run


def _shapes(points, triangles):
    return [geometry.to_wkb(geometry.Geometry(3, [[points[[a, b, c, a]]]])) for a, b, c in triangles.tolist()]


def triangulate(points_geom, breaklines_geom=None, merge_tolerance: float = 0.0) -> Column:
    """Array of triangles (WKB with Z) of an array of points; lines become edges. Explode it for a row each."""
    lines = F.lit(None).cast("array<binary>") if breaklines_geom is None else col(breaklines_geom)
    return _udf(_shapes, T.ArrayType(T.BinaryType()))(col(points_geom), lines, F.lit(float(merge_tolerance)))


def interpolateelevationbbox(points_geom, breaklines_geom, merge_tolerance, xmin, ymin, xmax, ymax, width, height) -> Column:
    """Array of Z points at the centres of a box's grid, column by column; none outside the hull."""
    dx, dy = (xmax - xmin) / width, (ymax - ymin) / height
    return interpolateelevationgeom(points_geom, breaklines_geom, merge_tolerance, xmin, ymin, width, height, dx, dy)


def interpolateelevationgeom(points_geom, breaklines_geom, merge_tolerance, x0, y0, columns, rows, dx, dy) -> Column:
    """The same on a grid given by its origin and cell size."""

    def at(points, triangles):
        x, y = (v.ravel() for v in np.meshgrid(x0 + (np.arange(columns) + 0.5) * dx, y0 + (np.arange(rows) + 0.5) * dy, indexing="ij"))
        z = heights(points, triangles, x, y)
        ok = ~np.isnan(z)
        return [geometry.to_wkb(geometry.Geometry(1, [np.array([q])])) for q in np.stack([x, y, z], axis=1)[ok]]

    lines = F.lit(None).cast("array<binary>") if breaklines_geom is None else col(breaklines_geom)
    return _udf(at, T.ArrayType(T.BinaryType()))(col(points_geom), lines, F.lit(float(merge_tolerance)))


def dtmfromgeoms(points, breaklines, merge_tolerance, xmin, ymin, xmax, ymax, width, height, srid, no_data=-9999.0) -> Column:
    """A tile of the heights of an array of points, NoData outside the hull."""

    def burn(p, t):
        r = blank(xmin, ymin, xmax, ymax, width, height, srid, no_data)
        xs, ys = r.centres()
        z = heights(p, t, xs.ravel(), ys.ravel()).reshape(xs.shape)
        r.bands[0] = np.where(np.isnan(z), no_data, z)
        return encode(r)

    lines = F.lit(None).cast("array<binary>") if breaklines is None else col(breaklines)
    return as_tile(_udf(burn, T.BinaryType())(col(points), lines, F.lit(float(merge_tolerance))))


def dtmfromgeoms_agg(point, breaklines, merge_tolerance, *grid) -> Column:
    """The same from the points of a group."""
    return dtmfromgeoms(F.array_sort(F.collect_list(col(point))), breaklines, merge_tolerance, *grid)
