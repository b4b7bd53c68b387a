"""Positions on the equal-area pixelisation of Gorski et al. 2005, NESTED order.

Each of the 12 base faces carries a unit square (x east, y north of its lowest
corner); ``spot`` maps a point of that square to the sphere, so that centers and
corners are one formula at different offsets.
"""

from __future__ import annotations

import numpy as np

from . import codec

# Half-cell offsets of the corners North, West, South, East.
CORNERS = ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))


def squeeze_bits(v: np.ndarray) -> np.ndarray:
    """Gather the even bits of v into its low half."""
    v = v & 0x5555555555555555
    for shift, mask in (
        (1, 0x3333333333333333),
        (2, 0x0F0F0F0F0F0F0F0F),
        (4, 0x00FF00FF00FF00FF),
        (8, 0x0000FFFF0000FFFF),
        (16, 0x00000000FFFFFFFF),
    ):
        v = (v | (v >> shift)) & mask
    return v


def spot(resolution, nested: np.ndarray, dx: float = 0.0, dy: float = 0.0):
    """(z, sin(theta), phi) of the point at cell center + (dx, dy) cells."""
    resolution = np.asarray(resolution, dtype=np.int64)
    nested = np.asarray(nested, dtype=np.int64)
    n = np.left_shift(np.int64(1), resolution).astype(np.float64)
    face = nested >> (2 * resolution)
    inside = nested & (np.left_shift(np.int64(1), 2 * resolution) - 1)
    x = (squeeze_bits(inside) + (0.5 + dx)) / n
    y = (squeeze_bits(inside >> 1) + (0.5 + dy)) / n
    ring = 2.0 + face // 4 - x - y
    lane = 2 * (face % 4) + np.where((face >= 4) & (face < 8), 0, 1)
    north, south = ring < 1.0, ring > 3.0
    cap = north | south
    width = np.where(north, ring, np.where(south, 4.0 - ring, 1.0))
    t = width * width / 3.0
    z = np.where(north, 1.0 - t, np.where(south, t - 1.0, (2.0 - ring) * (2.0 / 3.0)))
    sin_theta = np.sqrt(np.where(cap, t * (2.0 - t), (1.0 - z) * (1.0 + z)))
    safe = np.where(width > 0.0, width, 1.0)
    phi = np.where(width > 0.0, (np.pi / 4.0) * (lane * width + x - y) / safe, 0.0)
    return z, sin_theta, phi


def center_xyz(resolution, nested: np.ndarray) -> np.ndarray:
    z, s, phi = spot(resolution, nested)
    return np.stack([s * np.cos(phi), s * np.sin(phi), z], axis=-1)


def _degrees(z, s, phi):
    lon = np.degrees(np.arctan2(s * np.sin(phi), s * np.cos(phi)))
    lon = np.where(lon <= -180.0, 180.0, lon)
    lon = np.where(s == 0.0, 0.0, lon)
    return lon, np.degrees(np.arctan2(z, s))


def centers_lonlat(ids: np.ndarray) -> np.ndarray:
    r, nested = codec.decode(ids)
    return np.stack(_degrees(*spot(r, nested)), axis=-1)


def corners_lonlat(ids: np.ndarray) -> np.ndarray:
    """(n, 4, 2) degrees, counter-clockwise: north, west, south, east."""
    r, nested = codec.decode(ids)
    return np.stack([np.stack(_degrees(*spot(r, nested, dx, dy)), axis=-1) for dx, dy in CORNERS], axis=1)


def cell_radius(resolution: int) -> float:
    """Largest angle between a cell's center and any point of the cell."""
    n = 1 << resolution
    za, pa = 2.0 / 3.0, np.pi / (4 * n)
    zb = 1.0 - (1.0 - 1.0 / n) ** 2 / 3.0
    sa, sb = np.sqrt(1 - za * za), np.sqrt(max(0.0, 1 - zb * zb))
    return float(np.arccos(min(1.0, sa * sb * np.cos(pa) + za * zb)))


def lonlat_xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    c = np.cos(lat)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)], axis=-1)
