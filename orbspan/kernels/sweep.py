"""Which points lie in which convex polygons: a plane sweep over trapezoids of active edges.

Around the points' middle the sphere is projected from its center to a plane, where
arcs of great circles are straight.  A convex polygon is swept from vertex to vertex:
between two of its vertices exactly two of its edges are active, and the points
there lie in it if they lie between these.  Points are kept in strips along the
sweep, in order across it, so only points in the height of a trapezoid are met.
What is met by active edges is decided by the rule for all edges, on the sphere.

Polygons that reach beyond the projected part hold much of the sphere; all points
are tested for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import refine

STRIP = 64
#: Least cosine from the middle that is projected; slack of the plane for the roundings of the projection.
_PART, _SLACK = 0.1, 1e-9


def _frame(points: np.ndarray) -> np.ndarray:
    """(3, 3): two directions across and the middle of the points."""
    c = points.mean(0)
    size = float(np.sqrt((c * c).sum()))
    c = c / size if size > 1e-9 else np.array([0.0, 0.0, 1.0])
    u = np.cross(c, np.eye(3)[int(np.argmin(np.abs(c)))])
    u /= np.sqrt((u * u).sum())
    return np.stack([u, np.cross(c, u), c])


def sweep(points: np.ndarray, rings: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (point, polygon) index arrays, each pair once, for polygons (m, n, 3) around points (p, 3)."""
    if not len(points) or not len(rings):
        return
    normals = np.cross(rings, np.roll(rings, -1, axis=1))
    frame = _frame(points)
    flat, corners = points @ frame.T, rings @ frame.T
    part = np.flatnonzero(flat[:, 2] > _PART)
    planar = (corners[..., 2] > _PART).all(1)
    for k, who in _active(flat[part, :2] / flat[part, 2:], corners[planar, :, :2] / corners[planar, :, 2:], block):
        at, which = part[k], np.flatnonzero(planar)[who[0]]
        # the two active edges first, then the rule of the cover
        near = np.ones(len(at), dtype=bool)
        for e in who[1:]:
            near &= (normals[which, e] * points[at]).sum(1) >= refine.EDGE_RULE - 1e-12
        at, which = at[near], which[near]
        ok = refine.inside(normals[which], points[at])
        if ok.any():
            yield at[ok], which[ok]
    wide = np.flatnonzero(~planar)
    step = max(1, block // len(points))
    for lo in range(0, len(wide), step):
        some = wide[lo : lo + step]
        for begin in range(0, len(points), block):
            ok = (np.einsum("mnk,pk->mpn", normals[some], points[begin : begin + block]) >= refine.EDGE_RULE).all(-1)
            which, at = np.nonzero(ok)
            if len(at):
                yield begin + at, some[which]


def _active(points: np.ndarray, rings: np.ndarray, block: int):
    """Yields (point, (polygon, edge, edge)) where a point is met between two vertices of a polygon, in the height of its active edges."""
    many, n = rings.shape[:2]
    if not len(points) or not many:
        return
    if np.ptp(points[:, 1]) > np.ptp(points[:, 0]):
        points, rings = points[:, ::-1], rings[..., ::-1]
    order = np.argsort(points[:, 0], kind="stable")
    strip = np.arange(len(order)) // STRIP
    first = points[order, 0][::STRIP]
    order = order[np.lexsort((points[order, 1], strip))]
    x, y = points[order].T
    base, wide = y.min() - 1.0, float(np.ptp(y)) + 3.0
    key = strip * wide + (y - base)
    # slabs between the vertices of each polygon in the order of the sweep
    stops = np.sort(rings[..., 0], axis=1)
    low, high = stops[:, :-1].copy(), stops[:, 1:].copy()
    middle, real = (low + high) / 2, high > low
    a, b = rings, np.roll(rings, -1, axis=1)
    left, right = np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 0], b[..., 0])
    over = (left[:, None] <= middle[..., None]) & (middle[..., None] <= right[:, None])
    one, two = over.argmax(2), n - 1 - over[..., ::-1].argmax(2)
    bottom, top = np.full(low.shape, np.inf), np.full(low.shape, -np.inf)
    row = np.arange(many)[:, None]
    for e in (one, two):
        (ax, ay), (bx, by) = (np.moveaxis(v[row, e], -1, 0) for v in (a, b))
        with np.errstate(all="ignore"):
            slope = np.where(bx != ax, (by - ay) / (bx - ax), 0.0)
        for end in (low, high):
            height = ay + (end - ax) * slope
            bottom, top = np.minimum(bottom, height), np.maximum(top, height)
    low[:, 0] -= _SLACK
    high[:, -1] += _SLACK
    real[:, 0] = real[:, -1] = True
    who, slab = np.nonzero(real)
    low, high, bottom, top, one, two = (v[who, slab] for v in (low, high, bottom, top, one, two))
    begin = np.maximum(0, np.searchsorted(first, low, "left") - 1)
    size = np.maximum(0, np.searchsorted(first, high, "right") - begin)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, done + block // 8, "right")))
        t = np.repeat(np.arange(at, to), size[at:to])
        s = begin[t] + np.arange(len(t)) - np.repeat(ends[at:to] - size[at:to] - done, size[at:to])
        start = np.searchsorted(key, s * wide + np.clip(bottom[t] - _SLACK - base, 0.5, wide - 0.5), "left")
        count = np.maximum(0, np.searchsorted(key, s * wide + np.clip(top[t] + _SLACK - base, 0.5, wide - 0.5), "right") - start)
        stop = np.cumsum(count)
        for cut in range(0, int(stop[-1]) if len(stop) else 0, block):
            nth = np.arange(cut, min(int(stop[-1]), cut + block))
            which = np.searchsorted(stop, nth, "right")
            k, slab_ = start[which] + nth - (stop - count)[which], t[which]
            met = (low[slab_] <= x[k]) & (x[k] < high[slab_])
            k, slab_ = k[met], slab_[met]
            if len(k):
                yield order[k], (who[slab_], one[slab_], two[slab_])
        at = to
