"""k-d trees over unit vectors: cuts that split space into tasks, and local search."""

from __future__ import annotations

import numpy as np


class Cuts:
    """A complete k-d tree of ``2**depth`` leaves, as arrays of axes and cuts (heap order), for a number of points."""

    def __init__(self, sample: np.ndarray, depth: int, points: int | None = None):
        self.depth, self.points = depth, len(sample) if points is None else points
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int8)
        self.cut = np.zeros((1 << depth) - 1)
        self._fill(sample, 0)

    def _fill(self, points: np.ndarray, node: int) -> None:
        if node >= len(self.axis):
            return
        if len(points):
            a = int(np.argmax(points.max(0) - points.min(0)))
            c = float(np.median(points[:, a]))
        else:
            a, c = 0, 0.0
        self.axis[node], self.cut[node] = a, c
        left = points[:, a] < c
        self._fill(points[left], 2 * node + 1)
        self._fill(points[~left], 2 * node + 2)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)

    def touched(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for all leaves that a ball around the point reaches."""
        who, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            at, cut = points[who, self.axis[node]], self.cut[node]
            reach = radius[who]
            low, high = at - reach < cut, at + reach >= cut
            who, node = np.r_[who[low], who[high]], np.r_[2 * node[low] + 1, 2 * node[high] + 2]
        return who, node - len(self.axis)


class LocalTree:
    """Balanced k-d tree over one task's points, searched for many queries at once."""

    LEAF = 24

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / self.LEAF))))
        order, bounds = np.arange(n), np.array([0, n])
        for _ in range(self.depth):
            middles = (bounds[:-1] + bounds[1:]) // 2
            for lo, mid, hi in zip(bounds[:-1], middles, bounds[1:]):
                part = order[lo:hi]
                if hi - lo > 1:
                    p = points[part]
                    a = int(np.argmax(p.max(0) - p.min(0)))
                    order[lo:hi] = part[np.argpartition(p[:, a], mid - lo)]
            bounds = np.sort(np.r_[bounds, middles])
        self.order, self.bounds, self.points = order, bounds, points[order]
        full = np.flatnonzero(np.diff(bounds) > 0)
        low, high = np.full((len(bounds) - 1, 3), np.inf), np.full((len(bounds) - 1, 3), -np.inf)
        if n:
            low[full] = np.minimum.reduceat(self.points, bounds[:-1][full])
            high[full] = np.maximum.reduceat(self.points, bounds[:-1][full])
        self.boxes = [(low, high)]
        while len(self.boxes[0][0]) > 1:
            low, high = self.boxes[0]
            self.boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))

    def within(self, queries: np.ndarray, chord: float, block: int = 1 << 16):
        """Yields (query, point) index arrays of all pairs at most ``chord`` apart."""
        square = chord * chord
        step = max(1, block // 8)  # a query may reach many leaves
        for at in range(0, len(queries), step):
            who = np.arange(at, min(len(queries), at + step))
            node = np.zeros(len(who), dtype=np.int64)
            for level, (low, high) in enumerate(self.boxes):
                q = queries[who]
                gap = np.maximum(np.maximum(low[node] - q, q - high[node]), 0.0)
                near = (gap * gap).sum(1) <= square
                who, node = who[near], node[near]
                if level < len(self.boxes) - 1:
                    who, node = np.repeat(who, 2), (2 * node[:, None] + np.arange(2)).ravel()
            size = np.diff(self.bounds)[node]
            for lo in range(0, len(who), block):
                hi = min(len(who), lo + block)
                part = size[lo:hi]
                if not part.sum():
                    continue
                first = np.cumsum(part) - part
                point = np.arange(part.sum()) - np.repeat(first, part) + np.repeat(self.bounds[:-1][node[lo:hi]], part)
                query = np.repeat(who[lo:hi], part)
                d = queries[query] - self.points[point]
                hit = (d * d).sum(1) <= square
                yield query[hit], self.order[point[hit]]
