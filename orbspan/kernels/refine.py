"""Which cells have their center in a convex polygon, by refinement.

A frontier of (polygon, cell) pairs starts at the 12 base cells.  A cell whose
circumscribed cap lies outside one edge is dropped, one whose cap lies inside all
edges is taken whole as a range of the target resolution, the rest is split in
four.  At the target resolution the center rule decides.  Work follows the
polygon's outline, not its area.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from . import codec, grid

# A center is inside if dot(cross(v_i, v_i+1), center) is at least this, for all edges.
EDGE_RULE = -1e-14
_MARGIN = 1e-12
_FRONTIER = 1 << 17


# Resolutions whose centers are kept in memory, 1.6 MB in all.
_KEPT = 6


@lru_cache(maxsize=None)
def _all_centers(order: int) -> np.ndarray:
    return grid.center_xyz(order, np.arange(12 << 2 * order))


def _centers(order: int, cell: np.ndarray) -> np.ndarray:
    return _all_centers(order)[cell] if order <= _KEPT else grid.center_xyz(order, cell)


def inside(normals: np.ndarray, points: np.ndarray) -> np.ndarray:
    """normals (..., n, 3) not normalised, points (..., 3)."""
    return (np.einsum("...nk,...k->...n", normals, points) >= EDGE_RULE).all(-1)


def cover_ranges(rings: np.ndarray, resolution: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (polygon, first, last) of packed ids, both ends included.

    ``rings`` is (m, n, 3), normalised and counter-clockwise.  The frontier is
    taken in blocks, deepest first, so memory stays bounded however large the
    polygons are.  Ranges of one polygon are disjoint but come in no order.
    """
    codec.check_resolution(resolution)
    m = len(rings)
    if not m:
        return
    normals = np.cross(rings, np.roll(rings, -1, axis=1))
    units = normals / np.sqrt((normals * normals).sum(-1, keepdims=True))
    # a polygon whose vertices lie within a right angle of their mean lies in the cap around it
    middle = rings.sum(1)
    size = np.sqrt((middle * middle).sum(-1, keepdims=True))
    middle = np.divide(middle, size, out=np.zeros_like(middle), where=size > 1e-9)
    least = np.einsum("mnk,mk->mn", rings, middle).min(1)
    spread = np.where(least > 1e-6, np.arccos(np.clip(least, -1.0, 1.0)), np.pi)
    width = max(64, _FRONTIER // max(4, rings.shape[1]))
    marker = np.int64(1 << (4 + 2 * resolution))
    stack = []
    step = max(1, width // 12)
    for at in range(0, m, step):
        who = np.arange(at, min(m, at + step))
        stack.append((0, np.repeat(who, 12), np.tile(np.arange(12, dtype=np.int64), len(who))))
    while stack:
        order, who, cell = stack.pop()
        if len(who) > width:
            half = len(who) // 2
            stack += [(order, who[:half], cell[:half]), (order, who[half:], cell[half:])]
            continue
        points = _centers(order, cell)
        limit = np.cos(np.minimum(np.pi, spread[who] + grid.cell_radius(order) + 1e-6)) - _MARGIN
        near = (middle[who] * points).sum(1) >= limit
        who, cell, points = who[near], cell[near], points[near]
        if order == resolution:
            hit = inside(normals[who], points)
            if hit.any():
                ids = cell[hit] | marker
                yield who[hit], ids, ids
            continue
        reach = np.sin(grid.cell_radius(order))
        dots = np.einsum("fnk,fk->fn", units[who], points).min(1)
        whole = dots > reach + _MARGIN
        if whole.any():
            shift = 2 * (resolution - order)
            low = cell[whole] << shift
            yield who[whole], low | marker, (low + ((1 << shift) - 1)) | marker
        open_ = (dots >= -reach - _MARGIN) & ~whole
        if open_.any():
            stack.append((order + 1, np.repeat(who[open_], 4), (cell[open_, None] * 4 + np.arange(4)).ravel()))


def merge_ranges(who: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Sort ranges by polygon and id, and join those that touch."""
    order = np.lexsort((first, who))
    who, first, last = who[order], first[order], last[order]
    if len(who) < 2:
        return who, first, last
    cut = np.r_[True, (who[1:] != who[:-1]) | (first[1:] != last[:-1] + 1)]
    start = np.flatnonzero(cut)
    return who[start], first[start], last[np.r_[start[1:] - 1, len(who) - 1]]
