"""Rasters in memory and as GeoTIFF bytes.

The writer is deterministic: little-endian, bands apart, with the geotransform, the EPSG
code and NoData in the usual tags. A band is one DEFLATE strip, or tiles where ``block`` is
set; overviews are further images of the file, and of a tiled file all directories come
first, then the pixels of the smallest image up to the largest. The reader takes strips or
tiles, either byte order, chunky or separate bands, no compression, DEFLATE or PackBits,
and horizontal differencing.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# GDAL type names.
TYPES = {"Byte": "u1", "Int8": "i1", "UInt16": "u2", "Int16": "i2", "UInt32": "u4", "Int32": "i4", "Float32": "f4", "Float64": "f8"}
_NAMES = {np.dtype(v): k for k, v in TYPES.items()}
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass
class Raster:
    """bands (count, rows, columns), affine geotransform, EPSG code (0: none), NoData value or None, and tags."""

    bands: np.ndarray
    gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    srid: int = 0
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)
    #: Reduced images, the largest first; side of tiles (0: strips) and compression of the file.
    overviews: list[np.ndarray] = field(default_factory=list)
    block: int = 0
    compression: str = "DEFLATE"

    @property
    def count(self) -> int:
        return self.bands.shape[0]

    @property
    def height(self) -> int:
        return self.bands.shape[1]

    @property
    def width(self) -> int:
        return self.bands.shape[2]

    @property
    def type(self) -> str:
        return _NAMES[self.bands.dtype.newbyteorder("=")]

    def valid(self) -> np.ndarray:
        ok = ~np.isnan(self.bands) if self.bands.dtype.kind == "f" else np.ones(self.bands.shape, dtype=bool)
        if self.nodata is not None and not np.isnan(self.nodata):
            ok &= self.bands != self.bands.dtype.type(self.nodata) if self._holds(self.nodata) else True
        return ok

    def _holds(self, value: float) -> bool:
        if self.bands.dtype.kind == "f":
            return True
        info = np.iinfo(self.bands.dtype)
        return float(value).is_integer() and info.min <= value <= info.max

    def like(self, bands: np.ndarray, **changes) -> Raster:
        """The same place with other bands, and so without overviews or tiles."""
        made = {"gt": self.gt, "srid": self.srid, "nodata": self.nodata, "tags": dict(self.tags)} | changes
        return Raster(bands if bands.ndim == 3 else bands[None], **made)

    def xy(self, col, row):
        g = self.gt
        return g[0] + g[1] * col + g[2] * row, g[3] + g[4] * col + g[5] * row

    def colrow(self, x, y):
        g = self.gt
        d = g[1] * g[5] - g[2] * g[4]
        return (g[5] * (x - g[0]) - g[2] * (y - g[3])) / d, (g[1] * (y - g[3]) - g[4] * (x - g[0])) / d

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        col, row = np.meshgrid(np.arange(self.width) + 0.5, np.arange(self.height) + 0.5)
        return self.xy(col, row)

    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*(self.xy(c, r) for c in (0, self.width) for r in (0, self.height)), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def window(self, col: int, row: int, width: int, height: int) -> Raster:
        x, y = self.xy(col, row)
        return self.like(self.bands[:, row : row + height, col : col + width], gt=(x, self.gt[1], self.gt[2], y, self.gt[4], self.gt[5]))


#: TIFF numbers of the compressions that are written.
COMPRESSIONS = {"NONE": 1, "DEFLATE": 8}
_CODES = {"s": 2, "H": 3, "I": 4, "d": 12}


def _chunks(bands: np.ndarray, block: int, compression: str) -> list[bytes]:
    """A band's strip or its tiles, row by row, band after band; tiles are filled up with zeros."""
    data = np.ascontiguousarray(bands, bands.dtype.newbyteorder("<"))
    if block:
        n, h, w = data.shape
        padded = np.zeros((n, -(-h // block) * block, -(-w // block) * block), data.dtype)
        padded[:, :h, :w] = data
        parts = [padded[k, i : i + block, j : j + block] for k in range(n) for i in range(0, h, block) for j in range(0, w, block)]
    else:
        parts = list(data)
    return [zlib.compress(p.tobytes(), 6) if compression == "DEFLATE" else p.tobytes() for p in parts]


def _entries(r: Raster, bands: np.ndarray, chunks: list[bytes], reduced: bool) -> list[tuple[int, str, list]]:
    """One image's directory; the chunks' places are still 0."""
    n, (h, w), kind = bands.shape[0], bands.shape[1:], bands.dtype
    sizes = [len(c) for c in chunks]
    out: list[tuple[int, str, list]] = [
        (256, "I", [w]), (257, "I", [h]), (258, "H", [kind.itemsize * 8] * n), (259, "H", [COMPRESSIONS[r.compression]]), (262, "H", [1]), (277, "H", [n]), (284, "H", [2]), (339, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * n),
    ]
    out += [(322, "I", [r.block]), (323, "I", [r.block]), (324, "I", [0] * len(chunks)), (325, "I", sizes)] if r.block else [(273, "I", [0] * len(chunks)), (278, "I", [h]), (279, "I", sizes)]
    if n > 1:
        out.append((338, "H", [0] * (n - 1)))
    if r.nodata is not None:
        out.append((42113, "s", [repr(float(r.nodata)).encode() + b"\0"]))
    if reduced:
        return sorted([*out, (254, "I", [1])], key=lambda e: e[0])
    out.append((34264, "d", [r.gt[1], r.gt[2], 0, r.gt[0], r.gt[4], r.gt[5], 0, r.gt[3], 0, 0, 0, 0, 0, 0, 0, 1]))
    if r.srid:
        geographic = 4000 <= r.srid < 5000
        out.append((34735, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, r.srid]))
    if r.tags:
        items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in sorted(r.tags.items()))
        out.append((42112, "s", [f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"]))
    return sorted(out, key=lambda e: e[0])


def _raw(code: str, values: list) -> bytes:
    return values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)


def encode(r: Raster) -> bytes:
    """GeoTIFF bytes."""
    images = [r.bands, *r.overviews]
    chunks = [_chunks(b, r.block, r.compression) for b in images]
    directories = [_entries(r, b, c, k > 0) for k, (b, c) in enumerate(zip(images, chunks, strict=True))]
    sizes = [2 + 12 * len(d) + 4 + sum(len(raw) + len(raw) % 2 for _, code, values in d if len(raw := _raw(code, values)) > 4) for d in directories]
    starts = [8 + sum(sizes[:k]) for k in range(len(sizes))]
    at = 8 + sum(sizes)
    order = range(len(images) - 1, -1, -1) if r.block else range(len(images))
    places: dict[int, list[int]] = {}
    for k in order:
        places[k] = [at + sum(map(len, chunks[k][:c])) for c in range(len(chunks[k]))] if len(chunks[k]) < 64 else (at + np.concatenate([[0], np.cumsum([len(c) for c in chunks[k][:-1]])])).tolist()
        at += sum(map(len, chunks[k]))
    out = struct.pack("<2sHI", b"II", 42, 8)
    for k, entries in enumerate(directories):
        out += struct.pack("<H", len(entries))
        body, head = b"", starts[k] + 2 + 12 * len(entries) + 4
        for tag, code, values in entries:
            raw = _raw(code, places[k] if tag in (273, 324) else values)
            out += struct.pack("<HHI", tag, _CODES[code], len(raw) if code == "s" else len(values))
            if len(raw) > 4:
                out += struct.pack("<I", head + len(body))
                body += raw + b"\0" * (len(raw) % 2)
            else:
                out += raw.ljust(4, b"\0")
        out += struct.pack("<I", starts[k + 1] if k + 1 < len(starts) else 0) + body
    return out + b"".join(c for k in order for c in chunks[k])


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """(tags, place of the next directory or 0)."""
    tags: dict[int, tuple] = {}
    n = struct.unpack_from(order + "H", data, at)[0]
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = _SIZES.get(kind, "B")
        size = struct.calcsize("<" + code) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = (data[place : place + count],) if code == "s" else struct.unpack_from(f"{order}{count}{code}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _pixels(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """One image's bands."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, n = one(256, 0), one(257, 0), one(277, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    dtype = np.dtype(f"{order}{kind}{one(258, 8) // 8}")
    chunky, compression, predictor = one(284, 1) == 1, one(259, 1), one(317, 1)
    tiled = 322 in tags
    w, h = (one(322, width), one(323, height)) if tiled else (width, min(one(278, height), height))
    offsets, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    across, down, deep = -(-width // w), -(-height // h), n if chunky else 1
    out = np.zeros((n, height, width), dtype.newbyteorder("="))
    for k, (p, size) in enumerate(zip(offsets, sizes, strict=True)):
        band, rest = (0, k) if chunky else divmod(k, across * down)
        row, col = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - row)
        raw = _unpacked(data[p : p + size], compression)
        block = np.frombuffer(raw, dtype, rows * w * deep).reshape(rows, w, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: height - row, : width - col]
        if chunky:
            out[:, row : row + rows, col : col + w] = part.transpose(2, 0, 1)
        else:
            out[band, row : row + rows, col : col + w] = part[:, :, 0]
    return out


def decode(data: bytes, reduced: bool = False) -> Raster:
    """The raster of GeoTIFF bytes, with its overviews if asked for; ValueError for anything else."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    order = "<" if data[:2] == b"II" else ">"
    tags, following = _directory(data, order, struct.unpack_from(order + "I", data, 4)[0])
    out = _pixels(data, order, tags)
    overviews = []
    while reduced and following:
        more, following = _directory(data, order, following)
        if more.get(254, (0,))[0] & 1:
            overviews.append(_pixels(data, order, more))
    if 34264 in tags:
        m = tags[34264]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    keys = tags.get(34735, ())
    srid = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] != 32767), 0)
    text = lambda tag: tags[tag][0].rstrip(b"\0 ").decode("latin-1")
    nodata = float(text(42113)) if 42113 in tags else None
    import re

    named = dict(re.findall(r'<Item name="([^"]*)">([^<]*)</Item>', text(42112))) if 42112 in tags else {}
    named_compression = "NONE" if tags.get(259, (1,))[0] == 1 else "DEFLATE"
    return Raster(out, tuple(float(v) for v in gt), srid, nodata, named, overviews, tags[322][0] if reduced and 322 in tags else 0, named_compression if reduced else "DEFLATE")


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 32773:
        out, i = bytearray(), 0
        while i < len(raw):
            c = raw[i]
            if c < 128:
                out += raw[i + 1 : i + 2 + c]
                i += 2 + c
            else:
                out += raw[i + 1 : i + 2] * (257 - c) if c > 128 else b""
                i += 2
        return bytes(out)
    raise ValueError(f"TIFF compression {compression} isn't supported")


def png(rgba: np.ndarray) -> bytes:
    """PNG bytes of (rows, columns, 4) bytes."""
    h, w, _ = rgba.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
