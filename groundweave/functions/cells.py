"""Cells and chips of geometries on the three grids, and the algebra of chips.

A pandas UDF (Arrow batches) finds the cells of a geometry by position; their names are
then native expressions, so only what needs polygons leaves the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bng, custom_grid, geometry, quadbin
from .wkb import col

MAX_CELLS = 1_000_000
# Types as objects: workers import this module without a session that could parse their names.
_DOUBLES = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
_TILES = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
_CHIPS = T.ArrayType(T.StructType([*_TILES.elementType.fields, T.StructField("core", T.BooleanType()), T.StructField("chip", T.BinaryType())]))


def _grid_cells(g: geometry.Geometry, x0, y0, w, h, columns, rows):
    """Corner indices of the cells that the bounds touch."""
    bounds = g.bounds()
    if bounds is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, i, j = _block_cells(np.array([bounds]), x0, y0, w, h, columns, rows)
    return i, j


def _block_cells(bounds: np.ndarray, x0, y0, w, h, columns, rows):
    """(row of ``bounds``, i, j) of the cells that each row touches, row by row."""
    index = lambda v, low, size, n: np.clip(np.floor((v - low) / size), 0, n - 1).astype(np.int64)
    i0, i1 = index(bounds[:, 0], x0, w, columns), index(bounds[:, 2], x0, w, columns)
    j0, j1 = index(bounds[:, 1], y0, h, rows), index(bounds[:, 3], y0, h, rows)
    across, size = i1 - i0 + 1, (i1 - i0 + 1) * (j1 - j0 + 1)
    if (size > MAX_CELLS).any():
        raise ValueError("too many cells")
    owner = np.repeat(np.arange(len(bounds)), size)
    at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    return owner, i0[owner] + at % across[owner], j0[owner] + at // across[owner]


#: Corners of cell and ring pairs that are clipped at once.
_AT_ONCE = 1 << 20


def _chips(g: geometry.Geometry, i, j, x0, y0, w, h, keep_core: bool):
    """(x, y, core, chip) of the cells that hold something of the geometry."""
    left, low = x0 + i * w, y0 + j * h
    core = geometry.covers_boxes(g, left, low, left + w, low + h) if g.kind in (3, 6) else np.zeros(len(i), dtype=bool)
    chips: list[bytes | None] = []
    some = []
    for k in range(len(i)):
        b = (left[k], low[k], left[k] + w, low[k] + h)
        if core[k]:
            chips.append(geometry.to_wkb(geometry.box(*b)) if keep_core else None)
        elif (chip := geometry.clip_box(g, *b)) is not None:
            chips.append(geometry.to_wkb(chip))
        else:
            continue
        some.append(k)
    return i[some], j[some], core[some], chips


def _ring_chips(rings: np.ndarray, grid: tuple, keep_core: bool):
    """(ring, x, y, core, chip) for polygons of one ring of equal size (closed), all their cells together."""
    x0, y0, w, h, columns, rows = grid
    owner, i, j = _block_cells(np.concatenate([rings.min(axis=1), rings.max(axis=1)], axis=1), *grid)
    left, low = x0 + i * w, y0 + j * h
    boxes = np.stack([left, low, left + w, low + h], axis=1).astype(float)
    closed, count, size = geometry.clip_rings(rings[owner, :-1], boxes)
    core = size >= w * h * (1 - 1e-12)
    some = np.flatnonzero(core | (size > 1e-12 * w * h))
    chips = [(geometry.to_wkb(geometry.box(*boxes[k].tolist())) if keep_core else None) if core[k] else geometry.ring_wkb(closed[k, : count[k] + 1]) for k in some.tolist()]
    return owner[some], i[some], j[some], core[some], chips


def _all_chips(shapes: list, grid: tuple, keep_core: bool):
    """(row, x, y, core, chip) of all geometries' cells, in the order of rows."""
    found, single = [], {}
    for k, g in enumerate(shapes):
        if g is not None and g.kind == geometry.POLYGON and len(g.parts) == 1 and len(g.parts[0]) == 1 and len(g.parts[0][0]) > 3:
            single.setdefault(len(g.parts[0][0]), []).append(k)
        elif g is not None:
            x0, y0, w, h = grid[:4]
            i, j, core, chips = _chips(g, *_grid_cells(g, *grid), x0, y0, w, h, keep_core)
            found.append((np.full(len(i), k), i, j, core, chips))
    for size, at in single.items():
        rings = np.stack([shapes[k].parts[0][0][:, :2] for k in at])
        step = np.ptp(rings, axis=1) // np.array(grid[2:4]) + 2
        weight = np.cumsum(step.prod(axis=1) * size)
        cuts = np.searchsorted(weight, np.arange(0, weight[-1], _AT_ONCE)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if b > a:
                owner, *rest = _ring_chips(rings[a:b], grid, keep_core)
                found.append((np.array(at)[a:b][owner], *rest))
    joined = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4)]
    order = np.argsort(joined[0], kind="stable")
    chips = [c for f in found for c in f[4]]
    return *(c[order] for c in joined), [chips[k] for k in order.tolist()]


def _bng_cells(res: int, chips: bool, keep_core: bool):
    edge = bng.edge_of(res)
    grid = (0, 0, edge, edge, -(-bng.EAST_LIMIT // edge), -(-bng.NORTH_LIMIT // edge))

    @F.arrow_udf(_CHIPS)
    def found(values: pa.Array) -> pa.Array:
        shapes = [geometry.parse(v) for v in values.to_pylist()]
        if chips:
            row, x, y, core, parts = _all_chips(shapes, grid, keep_core)
        else:
            inside = []
            for k, g in enumerate(shapes):
                if g is not None:
                    i, j = _grid_cells(g, *grid)
                    at = geometry.contains(g, (i + 0.5) * edge, (j + 0.5) * edge)
                    inside.append((np.full(int(at.sum()), k), i[at], j[at]))
            row, x, y = (np.concatenate([f[c] for f in inside]) if inside else np.zeros(0, np.int64) for c in range(3))
            core, parts = np.zeros(len(row), dtype=bool), [None] * len(row)
        made = pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(core.astype(bool)), pa.array(parts, pa.binary())], ["x", "y", "core", "chip"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row.astype(np.int64), minlength=len(shapes)))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), made)

    return found, edge


def bng_polyfill(geom, res) -> Column:
    """Cells whose centre the geometry contains: all of them, islands too. Null gives an empty array."""
    r = bng.resolution_index(res)
    found, edge = _bng_cells(r, False, False)
    return F.transform(found(col(geom)), lambda c: bng.eastnorthasbng(c["x"] * edge, c["y"] * edge, r))


def bng_tessellate(geom, res, keep_core_geom: bool = False) -> Column:
    """Array of (cellid, core, chip): whole cells, with null chips unless asked for, and cut ones. A cut cell of several parts is one chip."""
    r = bng.resolution_index(res)
    found, edge = _bng_cells(r, True, keep_core_geom)
    return F.transform(found(col(geom)), lambda c: F.struct(bng.eastnorthasbng(c["x"] * edge, c["y"] * edge, r).alias("cellid"), c["core"].alias("core"), c["chip"].alias("chip")))


@F.pandas_udf(_DOUBLES("x", "y"))
def centroid_of(values: pd.Series) -> pd.DataFrame:
    """Centroid of each geometry."""
    xy = [(None, None) if v is None or not len((g := geometry.parse(v)).coordinates()) else geometry.centroid(g) for v in values]
    return pd.DataFrame(xy, columns=["x", "y"], dtype=float)


@F.pandas_udf(_DOUBLES("x", "y"))
def first_coordinate(values: pd.Series) -> pd.DataFrame:
    """First coordinate of each geometry."""
    xy = [(None, None) if v is None or not len(c := geometry.parse(v).coordinates()) else tuple(c[0, :2]) for v in values]
    return pd.DataFrame(xy, columns=["x", "y"], dtype=float)


@F.pandas_udf(_DOUBLES("xmin", "ymin", "xmax", "ymax"))
def bounds_of(values: pd.Series) -> pd.DataFrame:
    """Envelope of each geometry."""
    rows = [(None,) * 4 if v is None or (b := geometry.parse(v).bounds()) is None else b for v in values]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype=float)


@F.pandas_udf(T.DoubleType())
def area_of(values: pd.Series) -> pd.Series:
    """Area of each geometry in the units of its coordinates."""
    return pd.Series(geometry.areas([None if v is None else bytes(v) for v in values]))


def bng_pointascell(geom, res) -> Column:
    """The cell of a geometry's centroid."""
    p = centroid_of(col(geom))
    return bng.eastnorthasbng(p["x"], p["y"], res)


def bng_geomkring(geom, res, k) -> Column:
    """Cells within k of the geometry's cells."""
    cells = F.transform(bng_tessellate(geom, res), lambda c: c["cellid"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(cells, lambda c: bng.kring(c, k, res)))))


def bng_geomkloop(geom, res, k: int) -> Column:
    """Cells at distance k from the geometry's cells: its k-ring without its (k-1)-ring."""
    return F.array_except(bng_geomkring(geom, res, k), bng_geomkring(geom, res, k - 1))


def bng_tessellateexplode(geom, res, keep_core_geom: bool = False) -> Column:
    """A row (cellid, core, chip) for each cell of ``bng_tessellate``."""
    return F.inline(bng_tessellate(geom, res, keep_core_geom))


def _binary(operation):
    @F.pandas_udf(T.BinaryType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        made = [None if a is None or b is None else geometry.to_wkb(operation([geometry.parse(a), geometry.parse(b)])) for a, b in zip(left, right, strict=True)]
        return pd.Series(made, dtype=object)

    return run


_intersect, _unite = _binary(geometry.intersection), _binary(geometry.union)
_EMPTY = geometry.to_wkb(geometry.Geometry(3, []))


def _chip(cell: Column, core: Column, chip: Column) -> Column:
    return F.struct(cell.alias("cellid"), core.alias("core"), chip.alias("chip"))


def _merged(left, right, operation) -> Column:
    l, r = col(left), col(right)  # noqa: E741
    same = _chip(l["cellid"], l["core"], operation(l["chip"], r["chip"]))
    return F.when(l["core"], _chip(l["cellid"], l["core"], l["chip"])).when(r["core"], _chip(r["cellid"], r["core"], r["chip"])).when(l["cellid"] != r["cellid"], _chip(l["cellid"], l["core"], F.lit(_EMPTY))).otherwise(same)


def bng_cellintersection(left, right) -> Column:
    """Intersection of two chips. The order of questions is contractual: a core left, a core right, other cells, then geometry."""
    return _merged(left, right, _intersect)


def bng_cellunion(left, right) -> Column:
    return _merged(left, right, _unite)


def _folded(operation, core_wins: bool):
    def fold(ids: list, cores: list, chips: list) -> bytes:
        if len(set(ids)) > 1:
            if core_wins:
                return _EMPTY
            raise ValueError("chips of different cells")
        borders = [geometry.parse(c) for c, core in zip(chips, cores, strict=True) if not core and c is not None]
        if core_wins and any(cores) or not borders:
            return geometry.to_wkb(geometry.box(*bng_box(ids[0])))
        return geometry.to_wkb(operation(borders))

    @F.arrow_udf(T.BinaryType())
    def run(groups: pa.Array) -> pa.Array:
        out: list = [None] * len(groups)
        ends = groups.offsets.to_numpy() if len(groups) else np.zeros(1, np.int32)
        if ends[0] == ends[-1]:
            return pa.array(out, pa.binary())
        ids, cores, chips = groups.values.slice(ends[0], ends[-1] - ends[0]).flatten()
        ends = ends - ends[0]
        chips = chips.to_pylist()
        done = _fold_boxes(ends, ids, cores.fill_null(False).to_numpy(zero_copy_only=False), chips, core_wins, out)
        ids, cores = ids.to_pylist(), cores.to_pylist()
        for k in np.flatnonzero(~done & (np.diff(ends) > 0)).tolist():
            a, b = ends[k : k + 2].tolist()
            out[k] = fold(ids[a:b], cores[a:b], chips[a:b])
        return pa.array(out, pa.binary())

    return run


def _fold_boxes(ends, ids: pa.Array, cores: np.ndarray, chips: list, union: bool, out: list) -> np.ndarray:
    """Folds, all together, the groups whose border chips are upright rectangles and whose result is one; which groups those are."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    code = ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    other = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (code[1:] != code[:-1])], minlength=n) > 0
    border = ~cores & np.array([c is not None for c in chips])
    count = np.bincount(owner[border], minlength=n)
    at, boxes = geometry.upright_boxes(chips)
    mine = border[at]
    at, boxes = at[mine], boxes[mine]
    plain = ~other & (count > 0) & (np.bincount(owner[at], minlength=n) == count)
    if union:
        plain &= np.bincount(owner[cores], minlength=n) == 0
    mine = plain[owner[at]]
    at, boxes = at[mine], boxes[mine]
    done = np.zeros(n, dtype=bool)
    if not len(at):
        return done
    group, first, where = np.unique(owner[at], return_index=True, return_inverse=True)
    low, high = (np.minimum, np.maximum) if union else (np.maximum, np.minimum)
    made = np.concatenate([low.reduceat(boxes[:, :2], first), high.reduceat(boxes[:, 2:], first)], axis=1)
    # Slivers are left to the overlay, and so are unions that are no rectangle.
    good = (made[:, 2:] - made[:, :2] > 1e-9 * np.maximum(1, np.abs(made).max(axis=1, keepdims=True))).all(axis=1)
    if union:
        good &= np.bincount(where[(boxes == made[where]).all(axis=1)], minlength=len(group)) > 0
    for k, wkb in zip(group[good].tolist(), geometry.box_wkbs(made[good]), strict=True):
        out[k] = wkb
    done[group[good]] = True
    return done


def bng_box(cell: str) -> tuple[int, int, int, int]:
    """Bounds of one cell, as the native expression gives them."""
    quadrant = cell[-2:] if len(cell) > 2 and cell[-2:] in ("SW", "NW", "NE", "SE") else ""
    first = "STNOHJ".index(cell[0])
    at = bng._SECOND.index(cell[1]) if len(cell) > 1 else 20
    digits = cell[2 : len(cell) - len(quadrant)]
    k = len(digits) // 2
    unit = 10 ** (5 - k)
    edge = 500_000 if len(cell) == 1 else unit // 2 if quadrant else unit
    x = (first % 2 * 5 + at % 5) * 100_000 + int(digits[:k] or 0) * unit + (edge if quadrant in ("SE", "NE") else 0)
    y = ((first // 2 * 5 + 4 - at // 5) if len(cell) > 1 else 0) * 100_000 + int(digits[k:] or 0) * unit + (edge if quadrant in ("NW", "NE") else 0)
    return x, y, x + edge, y + edge


_intersection_agg, _union_agg = _folded(geometry.intersection, False), _folded(geometry.union, True)


def _group(chip) -> Column:
    """A group's chips as one array: folds take many groups at a time, where an aggregate of pandas takes one."""
    c = col(chip)
    return F.collect_list(F.struct(c["cellid"].alias("cellid"), c["core"].alias("core"), c["chip"].alias("chip")))


def bng_cellintersection_agg(chip) -> Column:
    """Intersection of a group's chips of one cell; whole cells are neutral. WKB."""
    return _intersection_agg(_group(chip))


def bng_cellunion_agg(chip) -> Column:
    """Union of a group's chips; a whole cell makes it whole, other cells make it empty. WKB."""
    return _union_agg(_group(chip))


def custom_pointascell(point, grid, res) -> Column:
    """The cell of a geometry's first coordinate."""
    p = first_coordinate(col(point))
    return custom_grid.pointascell_xy(p["x"], p["y"], grid, res)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _custom_positions(values: pd.Series, grids: pd.DataFrame, resolutions: pd.Series) -> pd.Series:
    out = []
    for v, spec, res in zip(values, grids.to_dict("records"), resolutions, strict=True):
        g = geometry.parse(v)
        if g is None:
            out.append(None)
            continue
        splits = spec["cell_splits"] ** int(res)
        w, h = spec["root_cell_size_x"] / splits, spec["root_cell_size_y"] / splits
        x0, y0 = spec["bound_x_min"], spec["bound_y_min"]
        columns = -(-(spec["bound_x_max"] - x0) // spec["root_cell_size_x"]) * splits
        rows = -(-(spec["bound_y_max"] - y0) // spec["root_cell_size_y"]) * splits
        i, j = _grid_cells(g, x0, y0, w, h, columns, rows)
        inside = geometry.contains(g, x0 + (i + 0.5) * w, y0 + (j + 0.5) * h)
        out.append((j[inside] * columns + i[inside]).tolist())
    return pd.Series(out, dtype=object)


def custom_polyfill(geom, grid, res) -> Column:
    """Cells whose centre the geometry contains."""
    r = col(res).cast("int")
    return F.transform(_custom_positions(col(geom), col(grid), r), lambda p: custom_grid._id(r, p))


@F.pandas_udf(_TILES)
def _envelope_tiles(values: pd.Series, resolutions: pd.Series) -> pd.Series:
    out = []
    for v, res in zip(values, resolutions, strict=True):
        g = geometry.parse(v)
        b = None if g is None else g.bounds()
        if b is None:
            out.append(None)
            continue
        n = 2 ** int(res)
        row = lambda lat: 0.5 - np.log((1 + (s := np.sin(np.radians(min(max(lat, -quadbin.MAX_LATITUDE), quadbin.MAX_LATITUDE))))) / (1 - s)) / (4 * np.pi)
        at = lambda share: int(min(max(np.floor(share * n), 0), n - 1))  # noqa: E731, B023
        x0, x1, y0, y1 = at((b[0] + 180) / 360), at((b[2] + 180) / 360), at(row(b[3])), at(row(b[1]))
        if (x1 - x0 + 1) * (y1 - y0 + 1) > quadbin.MAX_CELLS:
            raise ValueError("too many cells")
        out.append([{"x": x, "y": y} for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)])
    return pd.Series(out, dtype=object)


def quadbin_polyfill(geom, res) -> Column:
    """Every cell of the geometry's envelope."""
    r = quadbin._checked(res, quadbin.MAX_POLYFILL_RESOLUTION)
    return F.transform(_envelope_tiles(col(geom), r), lambda t: quadbin.from_tile(r, t["x"], t["y"]))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _cut(values: pd.Series, boxes: pd.Series) -> pd.Series:
    out = []
    for v, bs in zip(values, boxes, strict=True):
        if v is None or bs is None:
            out.append(None)
            continue
        g = geometry.parse(v)
        g.srid = 4326
        made = [geometry.clip_box(g, b[0], b[1], b[2], b[3]) for b in bs]
        out.append([None if m is None else geometry.to_wkb(m, srid=True) for m in made])
    return pd.Series(out, dtype=object)


def quadbin_tessellate(geom, res) -> Column:
    """Array of (cell, geom): the geometry's part in each cell of its envelope, where there is any."""
    g = col(geom)
    cells = quadbin_polyfill(g, res)
    chips = _cut(g, F.transform(cells, lambda c: F.array(*quadbin.bounds(c))))
    return F.transform(F.filter(F.arrays_zip(cells.alias("cell"), chips.alias("geom")), lambda z: z["geom"].isNotNull()), lambda z: F.struct(z["cell"].alias("cell"), z["geom"].alias("geom")))


def _quadbin_union(cells) -> bytes | None:
    c = np.unique(np.array([x for x in cells if x is not None], np.int64))
    if not len(c):
        return None
    z = c >> 52 & 31
    x, y = (sum(((c >> (2 * k + odd)) & 1) << k for k in range(26)) >> (26 - z) for odd in (0, 1))
    # Runs of cells along a row, and equal runs of rows that follow each other, are one box.
    order = np.lexsort((x, y, z))
    z, x, y = z[order], x[order], y[order]
    new = np.ones(len(z), dtype=bool)
    new[1:] = (z[1:] != z[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    z, x0, x1, y = z[first], x[first], x[np.append(first[1:], len(x)) - 1] + 1, y[first]
    order = np.lexsort((y, x1, x0, z))
    z, x0, x1, y = z[order], x0[order], x1[order], y[order]
    new = np.ones(len(z), dtype=bool)
    new[1:] = (z[1:] != z[:-1]) | (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1]) | (y[1:] != y[:-1] + 1)
    first = np.flatnonzero(new)
    n = 2.0 ** z[first]
    lat = lambda v: np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v / n))))
    corners = (x0[first] / n * 360 - 180, lat(y[np.append(first[1:], len(y)) - 1] + 1), x1[first] / n * 360 - 180, lat(y[first]))
    boxes = [geometry.box(*b, 4326) for b in zip(*(v.tolist() for v in corners), strict=True)]
    return geometry.to_wkb(boxes[0] if len(boxes) == 1 else geometry.union(boxes), srid=True)


@F.pandas_udf(T.BinaryType())
def quadbin_cellunion(cells: pd.Series) -> pd.Series:
    """Union of an array's cells, EWKB 4326."""
    return pd.Series([None if c is None else _quadbin_union(c) for c in cells], dtype=object)


@F.pandas_udf(T.BinaryType())
def _quadbin_union_agg(cells: pd.Series) -> bytes:
    return _quadbin_union(cells)


def quadbin_cellunion_agg(cell) -> Column:
    """Union of a group's cells, EWKB 4326."""
    return _quadbin_union_agg(col(cell))
