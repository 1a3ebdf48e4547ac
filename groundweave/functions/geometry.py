"""Geometry kernels in NumPy: well-known binary and text, containment, clipping, overlay.

A geometry is (kind, parts, srid): kind is the WKB type (1 point to 6 multipolygon), parts
a list of polygons, each a list of rings (shell first), or of lines and points as single
coordinate arrays. Overlay works on even-odd rings by slabs between all event ordinates,
so it takes any polygons, holes and multi-parts included; its result is made of trapezoids.
"""

from __future__ import annotations

import re
import struct

import numpy as np

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
_NAMES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}


class Geometry:
    def __init__(self, kind: int, parts: list, srid: int = 0):
        self.kind, self.parts, self.srid = kind, parts, srid

    def rings(self) -> list[np.ndarray]:
        return [r for p in self.parts for r in p] if self.kind in (POLYGON, MULTIPOLYGON) else []

    def coordinates(self) -> np.ndarray:
        arrays = self.rings() if self.kind in (POLYGON, MULTIPOLYGON) else self.parts
        return np.concatenate(arrays) if arrays else np.zeros((0, 2))

    def bounds(self) -> tuple[float, float, float, float] | None:
        c = self.coordinates()
        return None if not len(c) else (*c[:, :2].min(axis=0).tolist(), *c[:, :2].max(axis=0).tolist())


def parse(value) -> Geometry | None:
    """A geometry from WKB, EWKB, WKT or EWKT; None for null."""
    if value is None:
        return None
    if isinstance(value, str):
        return _from_wkt(value)
    return _Reader(bytes(value)).geometry()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def geometry(self, srid: int = 0) -> Geometry:
        order = "<" if self.data[self.at] else ">"
        code = struct.unpack_from(order + "I", self.data, self.at + 1)[0]
        self.at += 5
        if code & 0x20000000:
            srid = struct.unpack_from(order + "I", self.data, self.at)[0]
            self.at += 4
        flat = code & 0x1FFFFFFF
        size = 2 + bool(code & 0x80000000 or flat // 1000 in (1, 3)) + bool(code & 0x40000000 or flat // 1000 in (2, 3))
        kind = flat % 1000
        count = lambda: self._count(order)
        if kind == POINT:
            return Geometry(kind, [self._doubles(order, 1, size)], srid)
        if kind == LINE:
            return Geometry(kind, [self._doubles(order, count(), size)], srid)
        if kind == POLYGON:
            return Geometry(kind, [[self._doubles(order, count(), size) for _ in range(count())]], srid)
        members = [self.geometry(srid) for _ in range(count())]
        return Geometry(kind, [p for m in members for p in m.parts], srid)

    def _count(self, order: str) -> int:
        n = struct.unpack_from(order + "I", self.data, self.at)[0]
        self.at += 4
        return n

    def _doubles(self, order: str, n: int, size: int) -> np.ndarray:
        out = np.frombuffer(self.data, order + "f8", n * size, self.at).reshape(n, size).astype(float)
        self.at += 8 * n * size
        return out


def _from_wkt(text: str) -> Geometry:
    srid = 0
    if m := re.match(r"\s*SRID=(\d+);", text, re.I):
        srid, text = int(m[1]), text[m.end() :]
    m = re.match(r"\s*([A-Za-z]+)\s*(?:ZM|Z|M)?\s*(EMPTY|\(.*\))\s*$", text, re.S | re.I)
    if not m or m[1].upper() not in _NAMES:
        raise ValueError(f"not a geometry: {text[:60]!r}")
    kind = _NAMES[m[1].upper()]
    if m[2].upper() == "EMPTY":
        return Geometry(kind, [], srid)
    body = m[2]
    flat = [np.array([[float(v) for v in c.split()] for c in part.replace("(", " ").replace(")", " ").split(",")]) for part in re.findall(r"\(([^()]*)\)", body)]
    if kind == MULTIPOINT:
        return Geometry(kind, [p.reshape(1, -1) for a in (flat or []) for p in a], srid)
    if kind == POLYGON:
        return Geometry(kind, [flat], srid)
    if kind == MULTIPOLYGON:
        polygons = re.findall(r"\(\s*((?:\([^()]*\)\s*,?\s*)+)\)", body[1:-1])
        return Geometry(kind, [[np.array([[float(v) for v in c.split()] for c in ring.split(",")]) for ring in re.findall(r"\(([^()]*)\)", p)] for p in polygons], srid)
    return Geometry(kind, flat, srid)


def to_wkb(g: Geometry, srid: bool = False) -> bytes:
    """Little-endian WKB, or EWKB with its SRID."""
    size = g.coordinates().shape[1] if len(g.coordinates()) else 2
    z = 0x80000000 if size == 3 else 0

    def head(kind, own=False):
        return struct.pack("<BI", 1, kind | z | (0x20000000 if own and srid else 0)) + (struct.pack("<I", g.srid) if own and srid else b"")

    run = lambda c: struct.pack("<I", len(c)) + np.ascontiguousarray(c, "<f8").tobytes()
    polygon = lambda p, own: head(POLYGON, own) + struct.pack("<I", len(p)) + b"".join(map(run, p))
    if g.kind == POINT:
        return head(POINT, True) + np.ascontiguousarray(g.parts[0] if g.parts else np.full((1, 2), np.nan), "<f8").tobytes()
    if g.kind == LINE:
        return head(LINE, True) + run(g.parts[0] if g.parts else np.zeros((0, 2)))
    if g.kind == POLYGON:
        return polygon(g.parts[0] if g.parts else [], True)
    if g.kind == MULTIPOLYGON:
        return head(MULTIPOLYGON, True) + struct.pack("<I", len(g.parts)) + b"".join(polygon(p, False) for p in g.parts)
    member = POINT if g.kind == MULTIPOINT else LINE
    body = [head(member) + (np.ascontiguousarray(c, "<f8").tobytes() if member == POINT else run(c)) for c in g.parts]
    return head(g.kind, True) + struct.pack("<I", len(g.parts)) + b"".join(body)


def box(xmin, ymin, xmax, ymax, srid: int = 0) -> Geometry:
    return Geometry(POLYGON, [[np.array([[xmax, ymin], [xmax, ymax], [xmin, ymax], [xmin, ymin], [xmax, ymin]], float)]], srid)


def contains(g: Geometry, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside, by crossings of all rings."""
    inside = np.zeros(np.shape(x), dtype=bool)
    for ring in g.rings():
        for (x1, y1), (x2, y2) in zip(ring[:-1, :2].tolist(), ring[1:, :2].tolist(), strict=True):
            if y1 != y2:
                inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def area(g: Geometry) -> float:
    total = 0.0
    for polygon in g.parts if g.kind in (POLYGON, MULTIPOLYGON) else []:
        for k, ring in enumerate(polygon):
            x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
            size = abs(float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())) / 2
            total += -size if k else size
    return total


def centroid(g: Geometry) -> tuple[float, float]:
    """Of areas where there are any, else of lengths, else of points."""
    if g.kind in (POLYGON, MULTIPOLYGON) and area(g) > 0:
        sx = sy = total = 0.0
        for polygon in g.parts:
            for k, ring in enumerate(polygon):
                x, y = ring[:, 0], ring[:, 1]
                cross = (x[:-1] - x[0]) * (y[1:] - y[0]) - (x[1:] - x[0]) * (y[:-1] - y[0])
                a = cross.sum()
                if a:
                    w = (-1 if k else 1) * abs(a)
                    sx += w * (x[0] + ((x[:-1] + x[1:] - 2 * x[0]) * cross).sum() / (3 * a))
                    sy += w * (y[0] + ((y[:-1] + y[1:] - 2 * y[0]) * cross).sum() / (3 * a))
                    total += w
        return sx / total, sy / total
    if g.kind in (LINE, MULTILINE):
        mids = np.concatenate([(c[:-1, :2] + c[1:, :2]) / 2 for c in g.parts])
        size = np.concatenate([np.hypot(*(c[1:, :2] - c[:-1, :2]).T) for c in g.parts])
        if size.sum() > 0:
            return tuple(((mids * size[:, None]).sum(axis=0) / size.sum()).tolist())
    return tuple(g.coordinates()[:, :2].mean(axis=0).tolist())


def clip_ring(ring: np.ndarray, xmin: float, ymin: float, xmax: float, ymax: float) -> np.ndarray:
    """A ring cut to a rectangle, side by side; an empty array if nothing is left."""
    points = [tuple(p) for p in ring[:-1, :2].tolist()]
    for axis, limit, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        out = []
        for i, b in enumerate(points):
            a = points[i - 1]
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if (da < 0) != (db < 0) and da != db:
                t = da / (da - db)
                p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                p[axis] = limit
                out.append(tuple(p))
            if db >= 0:
                out.append(b)
        points = out
        if not points:
            return np.zeros((0, 2))
    kept = [p for i, p in enumerate(points) if p != points[i - 1]]
    return np.array([*kept, kept[0]]) if len(kept) > 2 else np.zeros((0, 2))


def clip_rings(points: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Open rings of equal size, each cut to its rectangle (xmin, ymin, xmax, ymax), all of them a side at a time.

    (points, counts, areas): row k holds the counts[k] corners of what is left in box k, closed by its first.
    """
    count = np.full(len(boxes), points.shape[1])
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        limit = boxes[:, side, None]
        at = np.arange(points.shape[1])
        there = at < count[:, None]
        before = np.take_along_axis(points, np.where(at == 0, count[:, None] - 1, at - 1)[:, :, None], axis=1) if points.shape[1] else points
        da, db = sign * (before[:, :, axis] - limit), sign * (points[:, :, axis] - limit)
        crosses = there & ((da < 0) != (db < 0)) & (da != db)
        t = np.divide(da, da - db, out=np.zeros_like(da), where=crosses)
        cut = before + t[:, :, None] * (points - before)
        cut[:, :, axis] = limit
        points, count = _packed(np.stack([cut, points], axis=2).reshape(len(boxes), -1, 2), np.stack([crosses, there & (db >= 0)], axis=2).reshape(len(boxes), -1))
    at = np.arange(points.shape[1])
    before = np.take_along_axis(points, np.where(at == 0, np.maximum(count, 1)[:, None] - 1, at - 1)[:, :, None], axis=1) if points.shape[1] else points
    points, count = _packed(points, (at < count[:, None]) & (points != before).any(axis=2))
    count = np.where(count > 2, count, 0)
    if not points.shape[1]:
        return np.zeros((len(boxes), 1, 2)), count, np.zeros(len(boxes))
    closed = np.concatenate([points, points[:, :1]], axis=1)
    closed[np.arange(len(boxes)), count] = closed[:, 0]
    x, y = closed[:, :, 0] - closed[:, :1, 0], closed[:, :, 1] - closed[:, :1, 1]
    cross = np.where(np.arange(points.shape[1]) < count[:, None], x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1], 0.0)
    return closed, count, np.abs(cross.sum(axis=1)) / 2


def _packed(points: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's kept points, moved to its front, and their number."""
    count = kept.sum(axis=1)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : int(count.max(initial=0))]
    return np.take_along_axis(points, order[:, :, None], axis=1), count


def ring_wkb(closed: np.ndarray) -> bytes:
    """A polygon of one ring."""
    return struct.pack("<BIII", 1, POLYGON, 1, len(closed)) + closed.tobytes()


def upright_boxes(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, boxes) of those WKBs that are a rectangle with level and plumb sides."""
    head = b"\x01" + struct.pack("<III", POLYGON, 1, 5)
    at = np.array([k for k, v in enumerate(values) if v is not None and len(v) == 93 and v[:13] == head], np.int64)
    ring = np.frombuffer(b"".join([values[k][13:] for k in at.tolist()]), "<f8").reshape(-1, 5, 2)
    step = np.diff(ring, axis=1)
    plumb = (step[:, 0, 0] == 0) & (step[:, 2, 0] == 0) & (step[:, 1, 1] == 0) & (step[:, 3, 1] == 0)
    level = (step[:, 0, 1] == 0) & (step[:, 2, 1] == 0) & (step[:, 1, 0] == 0) & (step[:, 3, 0] == 0)
    upright = (ring[:, 0] == ring[:, 4]).all(axis=1) & (plumb | level)
    return at[upright], np.concatenate([ring.min(axis=1), ring.max(axis=1)], axis=1)[upright]


def box_wkbs(boxes: np.ndarray) -> list[bytes]:
    """WKB of each row's rectangle, counter-clockwise from the lower left, as ``overlay`` makes it."""
    ring = np.ascontiguousarray(boxes[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]], "<f8").tobytes()
    head = b"\x01" + struct.pack("<III", POLYGON, 1, 5)
    return [head + ring[k : k + 80] for k in range(0, len(ring), 80)]


def areas(values: list[bytes | None]) -> np.ndarray:
    """Area of each WKB, NaN for null; little-endian polygons of one ring and equal size are taken together."""
    out = np.full(len(values), np.nan)
    groups: dict[int, list[int]] = {}
    for k, v in enumerate(values):
        if v is None:
            continue
        if v[:9] == b"\x01\x03\x00\x00\x00\x01\x00\x00\x00" and len(v) > 13:
            groups.setdefault(len(v), []).append(k)
        else:
            out[k] = area(parse(v))
    for size, at in groups.items():
        ring = np.frombuffer(b"".join([values[k][13:] for k in at]), "<f8").reshape(len(at), (size - 13) // 16, 2)
        x, y = ring[:, :, 0] - ring[:, :1, 0], ring[:, :, 1] - ring[:, :1, 1]
        out[at] = np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1)) / 2
    return out


def clip_box(g: Geometry, xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry | None:
    """A polygon's, line's or point's part in a rectangle; None if it has no area (length, point) there."""
    if g.kind in (POLYGON, MULTIPOLYGON):
        parts = []
        for polygon in g.parts:
            rings = [clip_ring(r, xmin, ymin, xmax, ymax) for r in polygon]
            if len(rings[0]):
                parts.append([r for r in rings if len(r)])
        made = Geometry(POLYGON if len(parts) == 1 else MULTIPOLYGON, parts, g.srid)
        whole = (xmax - xmin) * (ymax - ymin)
        return made if parts and area(made) > 1e-12 * whole else None
    if g.kind in (POINT, MULTIPOINT):
        kept = [p for p in g.parts if xmin <= p[0, 0] < xmax and ymin <= p[0, 1] < ymax]
        return Geometry(g.kind, kept, g.srid) if kept else None
    runs = []
    for line in g.parts:
        current: list = []
        for a, b in zip(line[:-1, :2], line[1:, :2], strict=True):
            t0, t1, d = 0.0, 1.0, b - a
            for p, q in ((-d[0], a[0] - xmin), (d[0], xmax - a[0]), (-d[1], a[1] - ymin), (d[1], ymax - a[1])):
                if p == 0:
                    if q < 0:
                        t1 = -1.0
                elif p < 0:
                    t0 = max(t0, q / p)
                else:
                    t1 = min(t1, q / p)
            if t0 < t1:
                s, e = a + t0 * d, a + t1 * d
                if current and np.array_equal(current[-1], s):
                    current.append(e)
                else:
                    if len(current) > 1:
                        runs.append(np.array(current))
                    current = [s, e]
        if len(current) > 1:
            runs.append(np.array(current))
    return Geometry(LINE if len(runs) == 1 else MULTILINE, runs, g.srid) if runs else None


def overlay(geometries: list[Geometry], keep) -> Geometry:
    """Where ``keep(inside)`` holds, ``inside`` being one flag per geometry; as trapezoids."""
    edges, owner = [], []
    for k, g in enumerate(geometries):
        for ring in g.rings():
            edges.append(np.hstack([ring[:-1, :2], ring[1:, :2]]))
            owner += [k] * (len(ring) - 1)
    if not edges:
        return Geometry(MULTIPOLYGON, [])
    e, owner = np.concatenate(edges), np.array(owner)
    flat = e[:, 1] == e[:, 3]
    e, owner = e[~flat], owner[~flat]
    swap = e[:, 1] > e[:, 3]
    e[swap] = e[swap][:, [2, 3, 0, 1]]
    x1, y1, x2, y2 = e.T
    slope = (x2 - x1) / (y2 - y1)
    levels = [y1, y2]
    for i in range(len(e)):  # crossings
        j = np.arange(i + 1, len(e))
        d = slope[i] - slope[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (x1[j] - slope[j] * y1[j] - x1[i] + slope[i] * y1[i]) / d
        good = (d != 0) & (y > np.maximum(y1[i], y1[j])) & (y < np.minimum(y2[i], y2[j]))
        levels.append(y[good])
    ys = np.unique(np.concatenate(levels))
    scale = max(1.0, float(np.abs(ys).max()))
    ys = ys[np.concatenate([[True], np.diff(ys) > 1e-13 * scale])]
    parts = []
    for low, high in zip(ys[:-1].tolist(), ys[1:].tolist(), strict=True):
        mid = (low + high) / 2
        live = np.flatnonzero((y1 < mid) & (y2 > mid))
        at = x1[live] + slope[live] * (mid - y1[live])
        live = live[np.argsort(at, kind="stable")]
        inside, begin = [False] * len(geometries), None
        for i in live.tolist():
            before = keep(inside)
            inside[owner[i]] = not inside[owner[i]]
            after = keep(inside)
            if after and not before:
                begin = i
            elif before and not after:
                f = lambda k, y: float(x1[k] + slope[k] * (y - y1[k]))
                a, b, c, d = f(begin, low), f(i, low), f(i, high), f(begin, high)
                if max(b - a, c - d) > 1e-12 * scale:
                    ring = [(a, low)] + ([(b, low)] if b > a else []) + [(c, high)] + ([(d, high)] if c > d else []) + [(a, low)]
                    parts.append([np.array(ring)])
    return Geometry(POLYGON if len(parts) == 1 else MULTIPOLYGON, parts, geometries[0].srid)


def union(geometries: list[Geometry]) -> Geometry:
    return overlay(geometries, any)


def intersection(geometries: list[Geometry]) -> Geometry:
    return overlay(geometries, all)


def covers_boxes(g: Geometry, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> np.ndarray:
    """Which boxes lie wholly inside: centre inside and no edge of the geometry through the box."""
    inside = contains(g, (xmin + xmax) / 2, (ymin + ymax) / 2)
    for ring in g.rings():
        for (ax, ay), (bx, by) in zip(ring[:-1, :2].tolist(), ring[1:, :2].tolist(), strict=True):
            if not inside.any():
                return inside
            near = inside & (xmin < max(ax, bx)) & (xmax > min(ax, bx)) & (ymin < max(ay, by)) & (ymax > min(ay, by))
            if near.any():
                side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)  # noqa: E731, B023
                corners = np.stack([side(xmin, ymin), side(xmax, ymin), side(xmin, ymax), side(xmax, ymax)])
                inside &= ~(near & (corners.min(axis=0) < 0) & (corners.max(axis=0) > 0))
    return inside
