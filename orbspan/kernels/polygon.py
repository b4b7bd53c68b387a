"""Validation of convex spherical polygons, many at once.

Polygons with the same number of vertices are stacked to (m, n, 3) and pass all
rules as array operations.  Every polygon gets a code; 0 is good, the others
index MESSAGES.  The order of the rules decides which message a polygon gets.
"""

from __future__ import annotations

import numpy as np

from . import grid

# Tolerances and messages of the footprint rules.
ZERO_NORM = 1e-15
SIDE_EPSILON = 1e-14
UNIT_TOLERANCE = 1e-6
SAME_VERTEX = 1e-12
MESSAGES = (
    None,
    "Each polygon needs at least three vertices.",
    "Unit-vector inputs must be finite.",
    "Encountered a zero-length vector.",
    "Unit-vector inputs must already be normalized within tolerance.",
    "Each polygon needs at least three unique vertices.",
    "Polygon contains duplicate consecutive vertices.",
    "Polygon contains duplicate vertices.",
    "Polygon is degenerate.",
    "Polygon is degenerate or numerically ambiguous.",
    "Polygon contains degenerate edges.",
    "Polygon must be convex.",
    "Footprint or vertex is null.",
    "lon/lat inputs must be finite.",
    "latitude must be between -90 and 90 degrees.",
)
NULL_INPUT, NOT_FINITE, BEYOND_POLES = 12, 13, 14
# Doubles in one block of a batch, so that memory does not follow the batch.
_BLOCK = 4_000_000


def ragged_groups(offsets: np.ndarray):
    """(n, rows) for each vertex count that occurs."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def normalize(flat: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None):
    """Codes, and the good rings by vertex count: [(rows, (m, n, 3))], counter-clockwise."""
    codes = np.zeros(len(offsets) - 1, dtype=np.int16)
    rings: list[tuple[np.ndarray, np.ndarray]] = []
    for n, rows in ragged_groups(offsets):
        if null is not None:
            codes[rows[null[rows]]] = NULL_INPUT
            rows = rows[~null[rows]]
        if n < 3:
            codes[rows] = 1
            continue
        step = max(1, _BLOCK // (n * n))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            v = flat[offsets[part][:, None] + np.arange(n)]
            _vectors(codes, part, v)
            good = codes[part] == 0
            part, v = part[good], v[good]
            if not len(part):
                continue
            v = v / np.sqrt((v * v).sum(-1, keepdims=True))
            closed = _same(v[:, 0], v[:, -1])
            for pick, ring in ((closed, v[closed, :-1]), (~closed, v[~closed])):
                if pick.any():
                    keep, ring = _ring(codes, part[pick], ring)
                    if len(keep):
                        rings.append((keep, ring))
    return codes, rings


def normalize_degrees(flat: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None):
    """normalize() of vertices (v, 2) in degrees: the first bad vertex of a polygon decides, polygons in their order."""
    finite = np.isfinite(flat).all(-1)
    kind = np.where(~finite, NOT_FINITE, np.where(np.abs(flat[:, 1]) > 90.0, BEYOND_POLES, 0))
    good = np.where(kind[:, None] > 0, 0.0, flat)
    codes, rings = normalize(grid.lonlat_xyz(good[:, 0], good[:, 1]), offsets, null)
    bad = np.flatnonzero(kind)
    owner = np.searchsorted(offsets, bad, side="right") - 1
    owner, first = np.unique(owner, return_index=True)
    # too few vertices and nulls come before the degrees, all other rules after them
    ahead = np.isin(codes[owner], (1, NULL_INPUT))
    codes[owner[~ahead]] = kind[bad[first[~ahead]]]
    kept = [(codes[rows] == 0, rows, ring) for rows, ring in rings]
    return codes, [(rows[k], ring[k]) for k, rows, ring in kept if k.any()]


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.abs(a - b) < SAME_VERTEX).all(-1)


def _first(codes: np.ndarray, rows: np.ndarray, bad: np.ndarray, code: int) -> None:
    hit = rows[bad & (codes[rows] == 0)]
    codes[hit] = code


def _vectors(codes: np.ndarray, rows: np.ndarray, v: np.ndarray) -> None:
    """The first bad vertex of each polygon decides its code."""
    finite = np.isfinite(v).all(-1)
    with np.errstate(all="ignore"):
        length = np.sqrt((v * v).sum(-1))
        kind = np.where(~finite, 2, np.where(length <= ZERO_NORM, 3, np.where(np.abs(length - 1.0) > UNIT_TOLERANCE, 4, 0)))
    bad = kind != 0
    at = bad.argmax(1)
    codes[rows] = kind[np.arange(len(rows)), at]


def _ring(codes: np.ndarray, rows: np.ndarray, v: np.ndarray):
    m, n, _ = v.shape
    if n < 3:
        codes[rows] = 5
        return rows[:0], v[:0]
    after = np.roll(v, -1, axis=1)
    _first(codes, rows, _same(v, after).any(1), 6)
    twins = np.zeros(m, dtype=bool)
    for k in range(2, n - 1):
        twins |= _same(v, np.roll(v, -k, axis=1)).any(1)
    _first(codes, rows, twins, 7)

    normal = np.cross(v, after)
    size = np.sqrt((normal * normal).sum(-1))
    inner = v.sum(1)
    flat = np.sqrt((inner * inner).sum(-1)) <= ZERO_NORM
    edge = size > ZERO_NORM
    _first(codes, rows, flat & ~edge.any(1), 8)
    inner = np.where(flat[:, None], normal[np.arange(m), edge.argmax(1)], inner)
    with np.errstate(all="ignore"):
        inner = inner / np.sqrt((inner * inner).sum(-1, keepdims=True))
    turn = np.einsum("mnk,mk->m", normal, inner)
    _first(codes, rows, ~(np.abs(turn) > SIDE_EPSILON), 9)
    back = turn < 0
    v = np.where(back[:, None, None], v[:, ::-1], v)
    normal = np.cross(v, np.roll(v, -1, axis=1))
    size = np.sqrt((normal * normal).sum(-1))
    side = np.einsum("mek,mvk->mev", normal, v)
    # edges are looked at in turn: degenerate, then not convex, then flat
    kind = np.where(size <= ZERO_NORM, 10, np.where((side < -SIDE_EPSILON).any(2), 11, np.where((side > SIDE_EPSILON).any(2), 0, 8)))
    wrong = kind != 0
    first = kind[np.arange(m), wrong.argmax(1)]
    good = codes[rows] == 0
    codes[rows[good]] = first[good]
    keep = codes[rows] == 0
    return rows[keep], v[keep]
