"""British National Grid cells (EPSG:27700) as native Column expressions.

Resolutions are 1 (100 km) to 6 (1 m) or, for quadrants, -1 (500 km) to -6 (5 m), or their
names; never metres. A cell's text is the letters of its 100 km square, the easting and
northing digits, and for quadrants SW, NW, NE or SE. A 500 km cell is one letter, taken
from the southernmost row whatever the northing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wkb import box_wkb, box_wkt, col, point_wkb

# Resolution names and their index.
RESOLUTIONS = {"500km": -1, "100km": 1, "50km": -2, "10km": 2, "5km": -3, "1km": 3, "500m": -4, "100m": 4, "50m": -5, "10m": 5, "5m": -6, "1m": 6}
_ROWS, _SECOND = ("ST", "NO", "HJ"), "ABCDEFGHJKLMNOPQRSTUVWXYZ"
EAST_LIMIT, NORTH_LIMIT = 800_000, 1_400_000


def resolution_index(res) -> int:
    """The index of a resolution given by index or name; ValueError for anything else."""
    if isinstance(res, str) and res in RESOLUTIONS:
        return RESOLUTIONS[res]
    if isinstance(res, int) and not isinstance(res, bool) and res in RESOLUTIONS.values():
        return res
    raise ValueError(f"no resolution of the British National Grid: {res!r}")


def edge_of(res: int) -> int:
    if res == -1:
        return 500_000
    return 10 ** (6 - res) if res > 0 else 10 ** (7 + res) // 2


def eastnorthasbng(e, n, res) -> Column:
    """The cell of an easting and northing."""
    r = resolution_index(res)
    e, n = col(e).cast("long"), col(n).cast("long")
    e100, n100 = (e / 100_000).cast("long"), (n / 100_000).cast("long")
    pick = lambda text, at: F.element_at(F.array(*(F.lit(c) for c in text)), (at + 1).cast("int"))
    first = pick("".join(_ROWS), (n100 / 5).cast("long") * 2 + (e100 / 5).cast("long"))
    if r == -1:
        return F.when(e.isNotNull() & n.isNotNull(), F.when(e < 500_000, F.lit("S")).otherwise(F.lit("T")))
    second = pick(_SECOND, (F.lit(4) - n100 % 5) * 5 + e100 % 5)
    digits = r - 1 if r > 0 else -r - 2
    out = [first, second]
    if digits:
        unit = 10 ** (5 - digits)
        out += [F.lpad(((v % 100_000) / unit).cast("long").cast("string"), digits, "0") for v in (e, n)]
    if r < 0:
        half = edge_of(r)
        east, north = (e % (2 * half)) >= half, (n % (2 * half)) >= half
        out.append(F.when(east & north, F.lit("NE")).when(east, F.lit("SE")).when(north, F.lit("NW")).otherwise(F.lit("SW")))
    return F.concat(*out)


def parts(cell) -> tuple[Column, Column, Column, Column]:
    """(x, y, edge, resolution) of a cell: its lower left corner and size in metres."""
    cell = col(cell).cast("string")
    pattern = r"^([A-Z]{1,2})([0-9]*)(SW|NW|NE|SE)?$"
    letters, digits, quadrant = (F.regexp_extract(cell, pattern, k) for k in (1, 2, 3))
    first = F.instr(F.lit("".join(_ROWS)), F.substring(letters, 1, 1)) - 1
    at = F.instr(F.lit(_SECOND), F.substring(letters, 2, 1)) - 1
    whole = F.length(letters) == 1
    e100 = F.when(whole, (first % 2) * 5).otherwise((first % 2) * 5 + at % 5)
    n100 = F.when(whole, F.lit(0)).otherwise((first / 2).cast("int") * 5 + 4 - (at / 5).cast("int"))
    k = (F.length(digits) / 2).cast("int")
    unit = F.pow(F.lit(10.0), 5 - k).cast("long")
    half = F.length(quadrant) > 0
    edge = F.when(whole, F.lit(500_000).cast("long")).when(half, (unit / 2).cast("long")).otherwise(unit)
    number = lambda text: F.coalesce(F.when(F.length(text) > 0, text.cast("long")), F.lit(0).cast("long"))
    x = e100.cast("long") * 100_000 + number(F.substring(digits, F.lit(1), k)) * unit + F.when(quadrant.isin("SE", "NE"), edge).otherwise(F.lit(0))
    y = n100.cast("long") * 100_000 + number(F.substring(digits, k + 1, k)) * unit + F.when(quadrant.isin("NW", "NE"), edge).otherwise(F.lit(0))
    res = F.when(whole, F.lit(-1)).when(half, -(k + 2)).otherwise(k + 1)
    return x, y, edge, res


def bounds(cell) -> tuple[Column, Column, Column, Column]:
    x, y, edge, _ = parts(cell)
    return x, y, x + edge, y + edge


def aswkb(cell) -> Column:
    return box_wkb(*bounds(cell))


def aswkt(cell) -> Column:
    return box_wkt(*bounds(cell))


def centroid_xy(cell) -> tuple[Column, Column]:
    x, y, edge, _ = parts(cell)
    return x + edge / 2, y + edge / 2


def centroid(cell) -> Column:
    return point_wkb(*centroid_xy(cell))


def cellarea(cell) -> Column:
    """Square kilometres."""
    edge = parts(cell)[2] / F.lit(1000.0)
    return edge * edge


def _steps(cell_a, cell_b) -> tuple[Column, Column]:
    (xa, ya, ea, ra), (xb, yb, eb, rb) = parts(cell_a), parts(cell_b)
    edge = F.when(ra <= rb, ea).otherwise(eb)  # the edge of the lesser signed resolution
    return F.floor(F.abs(xa - xb) / edge).cast("long"), F.floor(F.abs(ya - yb) / edge).cast("long")


def distance(cell_a, cell_b) -> Column:
    """Manhattan distance in cells."""
    dx, dy = _steps(cell_a, cell_b)
    return dx + dy


def euclideandistance(cell_a, cell_b) -> Column:
    """Chebyshev distance in cells, which is what this name stands for."""
    return F.greatest(*_steps(cell_a, cell_b))


def cell_at(x: Column, y: Column, res: Column) -> Column:
    """The cell of a corner at a resolution that is itself a column."""
    out = None
    for r in sorted(RESOLUTIONS.values()):
        out = F.when(res == r, eastnorthasbng(x, y, r)) if out is None else out.when(res == r, eastnorthasbng(x, y, r))
    return out


def _around(cell, k, hollow: bool, res=None) -> Column:
    x, y, edge, r = parts(cell)
    k = col(k).cast("long")
    named = (lambda px, py: eastnorthasbng(px, py, res)) if res is not None else (lambda px, py: cell_at(px, py, r))
    inside = lambda px, py: (px >= 0) & (py >= 0) & (px < EAST_LIMIT) & (py < NORTH_LIMIT)
    # One lambda over a block of steps: Spark can't hand nested ones to a Python function above.
    block = F.array_repeat(F.struct(x.alias("x"), y.alias("y"), edge.alias("edge"), k.alias("k"), (2 * k + 1).alias("side")), ((2 * k + 1) * (2 * k + 1)).cast("int"))
    column, row = (lambda t, i: i % t["side"] - t["k"]), (lambda t, i: F.floor(i / t["side"]) - t["k"])
    points = F.transform(block, lambda t, i: F.struct((t["x"] + column(t, i) * t["edge"]).alias("x"), (t["y"] + row(t, i) * t["edge"]).alias("y"), F.greatest(F.abs(column(t, i)), F.abs(row(t, i))).alias("d")))
    kept = F.filter(points, lambda p: inside(p["x"], p["y"]) & (p["d"] == k if hollow else F.lit(True)))
    return F.transform(kept, lambda p: named(p["x"], p["y"]))


def kring(cell, k, res=None) -> Column:
    """Cells within k of a cell and inside the grid. With ``res``, the cells' common resolution, the plan is shorter."""
    return _around(cell, k, False, None if res is None else resolution_index(res))


def kloop(cell, k, res=None) -> Column:
    """Cells at distance k exactly."""
    return _around(cell, k, True, None if res is None else resolution_index(res))
