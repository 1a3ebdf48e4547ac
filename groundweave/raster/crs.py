"""Coordinates between EPSG 4326, 3857 and the UTM zones 32601-32660 and 32701-32760."""

from __future__ import annotations

import numpy as np

_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Series of the transverse Mercator in the third flattening, to its third power.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _utm(srid: int) -> tuple[float, float] | None:
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return np.radians((srid % 100) * 6 - 183), 0.0 if srid < 32700 else 10_000_000.0
    return None


def known(srid: int) -> bool:
    return srid in (4326, 3857) or _utm(srid) is not None


def to_lonlat(x, y, srid: int):
    if srid == 4326:
        return x, y
    if srid == 3857:
        return np.degrees(x / _A), np.degrees(np.arctan(np.sinh(y / _A)))
    zone = _utm(srid)
    if zone is None:
        raise ValueError(f"EPSG:{srid} isn't supported")
    xi, eta = (y - zone[1]) / (0.9996 * _RADIUS), (x - 500_000) / (0.9996 * _RADIUS)
    a = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    b = eta - sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return np.degrees(zone[0] + np.arctan2(np.sinh(b), np.cos(a))), np.degrees(lat)


def from_lonlat(lon, lat, srid: int):
    if srid == 4326:
        return lon, lat
    if srid == 3857:
        lat = np.clip(lat, -89.9999, 89.9999)
        return np.radians(lon) * _A, np.arcsinh(np.tan(np.radians(lat))) * _A
    zone = _utm(srid)
    if zone is None:
        raise ValueError(f"EPSG:{srid} isn't supported")
    phi, lam = np.radians(lat), np.radians(lon) - zone[0]
    k = 2 * np.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(phi)) - k * np.arctanh(k * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    e = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500_000 + 0.9996 * _RADIUS * e, zone[1] + 0.9996 * _RADIUS * n


def convert(x, y, source: int, target: int):
    if source == target:
        return x, y
    return from_lonlat(*to_lonlat(x, y, source), target)
