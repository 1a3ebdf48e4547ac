"""User-defined rectangular grids as native Column expressions.

A grid is a struct of bounds, the splits of a cell's edge at each resolution, root cell
sizes and an SRID. A cell id holds the resolution in its upper 8 bits and the position
(row times columns plus column) in the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wkb import box_wkb, box_wkt, col, point_wkb

_POSITION = (1 << 56) - 1


def grid(x_min, x_max, y_min, y_max, cell_splits, root_x, root_y, srid=-1) -> Column:
    named = {"bound_x_min": (x_min, "long"), "bound_x_max": (x_max, "long"), "bound_y_min": (y_min, "long"), "bound_y_max": (y_max, "long"), "cell_splits": (cell_splits, "int"), "root_cell_size_x": (root_x, "int"), "root_cell_size_y": (root_y, "int"), "srid": (srid, "int")}
    return F.struct(*(col(v).cast(kind).alias(name) for name, (v, kind) in named.items()))


def max_resolution(grid_col) -> Column:
    """Finest resolution whose ids fit: 56 bits at ceil(log2(splits^2)) a level, at most 20."""
    bits = F.ceil(F.log2((col(grid_col)["cell_splits"] * col(grid_col)["cell_splits"]).cast("double")))
    return F.least(F.lit(20), F.floor(F.lit(56) / bits).cast("int"))


def _size(grid_col: Column, res: Column) -> tuple[Column, Column, Column, Column]:
    """(cell width, cell height, columns, rows) at a resolution."""
    splits = F.pow(grid_col["cell_splits"].cast("double"), res.cast("double"))
    w, h = grid_col["root_cell_size_x"] / splits, grid_col["root_cell_size_y"] / splits
    count = lambda a, b, root: (F.ceil((grid_col[b] - grid_col[a]) / grid_col[root].cast("double")) * splits).cast("long")
    return w, h, count("bound_x_min", "bound_x_max", "root_cell_size_x"), count("bound_y_min", "bound_y_max", "root_cell_size_y")


def _id(res: Column, position: Column) -> Column:
    return position.cast("long").bitwiseOR(F.shiftleft(res.cast("long"), 56))


def pointascell_xy(x, y, grid_col, res) -> Column:
    """The cell of a coordinate; bounds are half-open, outside or NaN raises an error."""
    g, res, x, y = col(grid_col), col(res).cast("int"), col(x).cast("double"), col(y).cast("double")
    w, h, columns, _ = _size(g, res)
    inside = (x >= g["bound_x_min"]) & (x < g["bound_x_max"]) & (y >= g["bound_y_min"]) & (y < g["bound_y_max"]) & ~F.isnan(x) & ~F.isnan(y)
    fits = (res >= 0) & (res <= max_resolution(g))
    position = F.floor((y - g["bound_y_min"]) / h) * columns + F.floor((x - g["bound_x_min"]) / w)
    return F.when(inside & fits, _id(res, position)).when(x.isNotNull() & y.isNotNull() & res.isNotNull(), F.raise_error(F.lit("a point outside the grid, or a resolution it lacks")).cast("long"))


def parts(cell, grid_col) -> tuple[Column, Column, Column, Column, Column, Column]:
    """(resolution, column, row, columns, cell width, cell height)."""
    cell, g = col(cell).cast("long"), col(grid_col)
    res = F.shiftrightunsigned(cell, 56).cast("int")
    w, h, columns, _ = _size(g, res)
    position = cell.bitwiseAND(F.lit(_POSITION))
    return res, position % columns, F.floor(position / columns).cast("long"), columns, w, h


def bounds(cell, grid_col) -> tuple[Column, Column, Column, Column]:
    g = col(grid_col)
    _, x, y, _, w, h = parts(cell, grid_col)
    return g["bound_x_min"] + x * w, g["bound_y_min"] + y * h, g["bound_x_min"] + (x + 1) * w, g["bound_y_min"] + (y + 1) * h


def cellaswkb(cell, grid_col) -> Column:
    return box_wkb(*bounds(cell, grid_col))


def cellaswkt(cell, grid_col) -> Column:
    return box_wkt(*bounds(cell, grid_col))


def centroid_xy(cell, grid_col) -> tuple[Column, Column]:
    a, b, c, d = bounds(cell, grid_col)
    return (a + c) / 2, (b + d) / 2


def centroid(cell, grid_col) -> Column:
    return point_wkb(*centroid_xy(cell, grid_col))


def kring(cell, grid_col, k) -> Column:
    """Cells within k of a cell. As in the engine matched here, the upper clamp is the number of cells itself, so edge cells give ids one beyond the grid."""
    g, k = col(grid_col), col(k).cast("long")
    res, x, y, columns, _, _ = parts(cell, grid_col)
    rows = _size(g, res)[3]
    low = lambda v: F.greatest(F.lit(0).cast("long"), v - k)
    return _block(res, columns, low(x), F.least(columns, x + k), low(y), F.least(rows, y + k))


def _block(res: Column, columns: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The cells of a block of positions, row by row, by one lambda: Spark can't hand nested ones to a Python function above."""
    corner = F.struct(res.alias("res"), columns.alias("columns"), x0.alias("x"), y0.alias("y"), (x1 - x0 + 1).alias("n"))
    block = F.array_repeat(corner, ((x1 - x0 + 1) * (y1 - y0 + 1)).cast("int"))
    return F.transform(block, lambda t, i: _id(t["res"], (t["y"] + F.floor(i / t["n"])) * t["columns"] + t["x"] + i % t["n"]))


def box_cells(xmin, ymin, xmax, ymax, grid_col, res) -> Column:
    """Cells that a box within the grid touches, from which polyfill keeps those whose centre a geometry holds."""
    g, res = col(grid_col), col(res).cast("int")
    w, h, columns, rows = _size(g, res)
    index = lambda v, low, size, n: F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor((v - g[low]) / size).cast("long")))
    across = [index(col(v), "bound_x_min", w, columns) for v in (xmin, xmax)]
    return _block(res, columns, *across, *(index(col(v), "bound_y_min", h, rows) for v in (ymin, ymax)))
