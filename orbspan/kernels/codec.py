"""Packed cell ids: one marker bit above the NESTED index tells the resolution.

``id = (1 << (4 + 2 r)) | nested`` with ``0 <= nested < 12 * 4**r``.  The ids of
resolution ``r`` are therefore exactly ``16 * 4**r .. 28 * 4**r - 1``, which is
how validity is tested here and in the Column version.
"""

from __future__ import annotations

import numpy as np

MAX_RESOLUTION = 29
BAD_ID = "cell_id is not a valid packed HEALPix token."
BAD_NESTED = "nested_index is out of range for the given resolution."
BAD_RESOLUTION = "resolution must be between 0 and 29."

_STARTS = np.array([16 << (2 * r) for r in range(MAX_RESOLUTION + 1)], dtype=np.int64)
_STOPS = np.array([28 << (2 * r) for r in range(MAX_RESOLUTION + 1)], dtype=np.int64)


def check_resolution(r: int) -> int:
    if not 0 <= r <= MAX_RESOLUTION:
        raise ValueError(BAD_RESOLUTION)
    return r


def resolution_of(ids: np.ndarray) -> np.ndarray:
    """Resolution of each id, -1 where it is not valid."""
    ids = np.asarray(ids, dtype=np.int64)
    r = np.searchsorted(_STARTS, ids, side="right") - 1
    ok = (r >= 0) & (ids < _STOPS[np.maximum(r, 0)])
    return np.where(ok, r, -1)


def is_valid(ids: np.ndarray) -> np.ndarray:
    return resolution_of(ids) >= 0


def encode(r: int, nested: np.ndarray) -> np.ndarray:
    check_resolution(r)
    nested = np.asarray(nested, dtype=np.int64)
    if nested.size and (nested.min() < 0 or nested.max() >= 12 << (2 * r)):
        raise ValueError(BAD_NESTED)
    return nested | np.int64(1 << (4 + 2 * r))


def decode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(resolution, nested) of each id; raises on the first that is not valid."""
    ids = np.asarray(ids, dtype=np.int64)
    r = resolution_of(ids)
    if (r < 0).any():
        raise ValueError(BAD_ID)
    return r, ids ^ _STARTS[r]
