import numpy as np
import pytest

import orbspan
from orbspan.api import check_offsets, cover_lonlat
from orbspan.kernels import codec, grid, polygon, refine


def xyz(*lonlat):
    a = np.array(lonlat, dtype=float)
    return grid.lonlat_xyz(a[:, 0], a[:, 1])


QUAD = ((-5, -5), (12, -4), (10, 9), (-6, 7))


def brute(vertices, r):
    v = vertices / np.linalg.norm(vertices, axis=1, keepdims=True)
    if np.abs(v[0] - v[-1]).max() < 1e-12:
        v = v[:-1]
    if (np.cross(v, np.roll(v, -1, axis=0)) @ v.sum(0)).sum() < 0:
        v = v[::-1]
    ids = codec.encode(r, np.arange(12 << 2 * r))
    c = grid.center_xyz(r, np.arange(12 << 2 * r))
    return ids[((c @ np.cross(v, np.roll(v, -1, axis=0)).T) >= -1e-14).all(1)]


def test_codec_limits():
    assert codec.is_valid(np.array([16, 27, 28, 31, 32, 64, 111, 0, -5, 7 * 2**60 - 1, 7 * 2**60])).tolist() == [
        True, True, False, False, False, True, True, False, False, True, False,
    ]
    for r in range(30):
        top = (12 << 2 * r) - 1
        assert [x.tolist() for x in codec.decode(codec.encode(r, np.array([0, top])))] == [[r, r], [0, top]]
    with pytest.raises(ValueError, match="nested_index is out of range"):
        codec.encode(1, np.array([48]))
    with pytest.raises(ValueError, match="between 0 and 29"):
        codec.encode(30, np.array([0]))


def test_grid_is_equal_area_and_nested():
    for r in range(5):
        c = grid.center_xyz(r, np.arange(12 << 2 * r))
        assert np.allclose(np.linalg.norm(c, axis=1), 1) and np.abs(c.mean(0)).max() < 1e-12
        assert len(np.unique(c.round(9), axis=0)) == 12 << 2 * r
        finer = grid.center_xyz(r + 1, np.arange(12 << 2 * (r + 1))).reshape(-1, 4, 3)
        angle = np.arccos(np.clip((finer * c[:, None]).sum(-1), -1, 1))
        assert angle.max() < grid.cell_radius(r)
    assert np.allclose(orbspan.centers(np.array([16, 20, 22])), [[45, 41.810315], [0, 0], [180, 0]])
    assert np.allclose(
        orbspan.boundaries(1041), [[73.125, 35.685335], [67.5, 30], [73.125, 24.624318], [78.75, 30]]
    )
    pole = orbspan.boundaries(19)  # base face 3 meets the pole
    assert np.allclose(pole[0], [0, 90])


@pytest.mark.parametrize(
    "points,r,want",
    [
        (QUAD, 2, [326]),
        (QUAD, 3, [1306, 1328]),
        (((20, -10), (33, -10), (33, 0), (20, 0)), 2, [324]),
        (((170, -8), (-170, -8), (-170, 8), (170, 8)), 2, []),
        (((170, -8), (-170, -8), (-170, 8), (170, 8)), 3, [1423, 1434, 1445, 1456]),
        (((-45, 70), (45, 70), (135, 70), (-135, 70)), 3, [*range(1084, 1088), *range(1148, 1152), *range(1212, 1216), *range(1276, 1280)]),
    ],
)
def test_goldens(points, r, want):
    for v in (xyz(*points), xyz(*points)[::-1], xyz(*points, points[0])):
        assert orbspan.cover_footprint(v, r).cell_ids.tolist() == want


def test_random_polygons_against_brute_force():
    rng = np.random.default_rng(5)
    for k in range(60):
        n = int(rng.integers(3, 9))
        middle = rng.normal(size=3)
        middle /= np.linalg.norm(middle)
        if k % 10 == 0:
            middle = np.array([0, 0, -1.0])
        side = np.cross(middle, rng.normal(size=3))
        side /= np.linalg.norm(side)
        up = np.cross(middle, side)
        radius, turn = rng.uniform(0.03, 1.4), np.sort(rng.uniform(0, 2 * np.pi, n))
        v = np.cos(radius) * middle + np.sin(radius) * (np.cos(turn)[:, None] * side + np.sin(turn)[:, None] * up)
        codes, _ = polygon.normalize(v, np.array([0, n]))
        if codes[0]:
            continue
        for r in (0, 3, 5):
            assert orbspan.cover_footprint(v, r).cell_ids.tolist() == brute(v, r).tolist()


def test_batches_equal_singles_and_swath_equals_quads():
    many = np.stack([xyz(*QUAD), xyz((20, -10), (33, -10), (33, 0), (20, 0)), xyz((0, 0.1), (0.2, 0.1), (0.2, 0.2), (0, 0.2))])
    got = orbspan.cover_footprint(many, 5)
    assert got.counts.tolist() == [len(orbspan.cover_footprint(v, 5).cell_ids) for v in many] and got.counts[2] == 0
    left, right = xyz((-5, -5), (-4, 0), (-3, 5)), xyz((5, -5), (4, 0), (3, 5))
    swath = orbspan.cover_swath(left, right, 3)
    assert swath.cell_ids.tolist() == [1295, 1328] and swath.offsets.tolist() == [0, 1, 2]
    pivot = orbspan.cover_swath(xyz((0, 0), (0, 0)), xyz((5, -5), (5, 5)), 4)  # a triangle
    assert pivot.cell_ids.tolist() == brute(xyz((0, 0), (5, -5), (5, 5)), 4).tolist()
    with pytest.raises(ValueError, match="duplicate consecutive"):
        orbspan.cover_swath(xyz((5, -5), (5, 5)), xyz((0, 0), (0, 0)), 4)
    with pytest.raises(ValueError, match="at least two"):
        orbspan.cover_swath(left[:1], right[:1], 3)
    with pytest.raises(ValueError, match="same number"):
        orbspan.cover_swath(left, right[:2], 3)


def test_benchmark_sizes():
    lat, lon = (x.ravel() for x in np.meshgrid(np.linspace(-55, 55, 20), np.linspace(-160, 160, 25), indexing="ij"))
    quads = np.stack([grid.lonlat_xyz(lon + a, lat + b) for a, b in ((-0.35, -0.25), (0.35, -0.25), (0.35, 0.25), (-0.35, 0.25))], axis=1)
    for r, n, empty in ((4, 8, 492), (6, 166, 334), (7, 672, 20)):
        got = orbspan.cover_footprint(quads, r)
        assert (len(got.cell_ids), int((got.counts == 0).sum())) == (n, empty)
    s = np.linspace(-40, 40, 501)
    got = orbspan.cover_swath(grid.lonlat_xyz(0 * s - 5, s), grid.lonlat_xyz(0 * s + 5, s), 7)
    assert len(got.cell_ids) == 3596 and len(np.unique(got.cell_ids)) == 3582


@pytest.mark.parametrize(
    "v,message",
    [
        (xyz((0, 0), (1, 0)), "at least three vertices"),
        (xyz((0, 0), (1, 0), (0, 0)), "at least three unique"),
        (xyz((0, 0), (1, 0), (1, 0), (0, 1)), "duplicate consecutive"),
        (xyz((0, 0), (1, 0), (0, 1), (1, 0), (2, 2)), "duplicate vertices"),
        (xyz((0, 0), (2, 0), (1, 1), (2, 2), (0, 2)), "must be convex"),
        (2 * xyz(*QUAD), "normalized within tolerance"),
        (0 * xyz(*QUAD), "zero-length"),
        (np.nan * xyz(*QUAD), "finite"),
        (xyz((0, 0), (120, 0), (-120, 0)), "degenerate"),
        (xyz((0, 0), (0.00000001, 0), (0, 0.00000001)), "ambiguous"),
    ],
)
def test_footprint_rules(v, message):
    with pytest.raises(ValueError, match=message):
        orbspan.cover_footprint(v, 3)


def test_argument_kinds():
    for bad in (2.0, "2", True):
        with pytest.raises(TypeError):
            orbspan.cover_footprint(xyz(*QUAD), bad)
    for bad in (-1, 30):
        with pytest.raises(ValueError, match="between 0 and 29"):
            orbspan.cover_footprint(xyz(*QUAD), bad)
    with pytest.raises(ValueError, match="between 0 and 29"):
        orbspan.cover_footprint(np.empty((0, 4, 3)), 30)
    with pytest.raises(ValueError, match="duplicate"):  # geometry is looked at first
        orbspan.cover_footprint(xyz((0, 0), (1, 0), (1, 0), (0, 1)), 30)
    assert orbspan.cover_footprint(xyz(*QUAD), np.int64(2)).cell_ids.tolist() == [326]
    for shape in ((0, 4, 3), (0, 0, 3)):
        assert orbspan.cover_footprint(np.empty(shape), 1).offsets.tolist() == [0]
    for shape in ((4, 2), (3,)):
        with pytest.raises(ValueError, match="must have shape"):
            orbspan.cover_footprint(np.empty(shape), 1)
    with pytest.raises(ValueError, match="at least one vertex"):
        orbspan.cover_footprint(np.empty((1, 0, 3)), 1)
    for bad in (256.0, [256.9], True, [True], []):
        with pytest.raises(TypeError):
            orbspan.centers(bad)
    for bad in (0, 32, 28, [16, 28], -1, [-1], 2**63, [[16]]):
        with pytest.raises(ValueError):
            orbspan.boundaries(bad)
    with pytest.raises(OverflowError):
        orbspan.centers(2**64)
    assert orbspan.centers(np.empty(0, np.uint64)).shape == (0, 2) and orbspan.boundaries(np.empty(0, np.uint64)).shape == (0, 4, 2)
    assert orbspan.centers([16, 1041, 4219])[1].tolist() == list(orbspan.centers(1041))
    assert sorted(orbspan.__all__) == ["Coverage", "__version__", "boundaries", "centers", "cover_footprint", "cover_swath"]


def test_offsets_and_lonlat():
    for bad, message in (([], "one value"), ([1, 4], "start at 0"), ([0, 3], "end at"), ([0, 3, 2, 4], "nondecreasing")):
        with pytest.raises(ValueError, match=message):
            check_offsets(np.array(bad, dtype=np.int64), 4)
    got = cover_lonlat(np.array([*QUAD, (20, -10), (33, -10), (33, 0)], dtype=float), np.array([0, 4, 7]), 4)
    assert len(got.counts) == 2
    assert cover_lonlat(np.array(QUAD) + [360.0, 0], np.array([0, 4]), 3).cell_ids.tolist() == [1306, 1328]
    for bad, message in (([(0, 91), (1, 0), (0, 1)], "latitude"), ([(np.inf, 0), (1, 0), (0, 1)], "finite")):
        with pytest.raises(ValueError, match=message):
            cover_lonlat(np.array(bad, dtype=float), np.array([0, 3]), 3)


def test_whole_cells_are_taken_as_ranges():
    rings = polygon.normalize(xyz(*QUAD), np.array([0, 4]))[1][0][1]
    parts = [np.concatenate(x) for x in zip(*refine.cover_ranges(rings, 14))]
    assert len(parts[0]) < 60_000 and (parts[2] - parts[1] + 1).sum() == 16_353_694


def polygons(rng, many, corners, size):
    """Convex polygons around random centers, some with a vertex on the line of two others, some as wide as a third of the sphere."""
    out = []
    for k in range(many):
        c = rng.normal(size=3)
        c /= np.linalg.norm(c)
        u = np.cross(c, [0.3, 0.5, -0.8])
        u /= np.linalg.norm(u)
        v = np.cross(c, u)
        angle = np.sort(rng.uniform(0, 2 * np.pi, corners)) if k % 3 else np.arange(corners) * 2 * np.pi / corners
        if np.diff(np.r_[angle, angle[0] + 2 * np.pi]).max() > 2.9:
            angle = np.arange(corners) * 2 * np.pi / corners
        radius = 1.2 if k % 19 == 7 else size * rng.uniform(0.2, 2)
        ring = c + np.tan(min(radius, 1.3)) * (np.cos(angle)[:, None] * u + np.sin(angle)[:, None] * v)
        if k % 5 == 1:
            ring[1] = (ring[0] + ring[2]) / 2
        out.append(ring / np.linalg.norm(ring, axis=1, keepdims=True))
    return np.array(out)


@pytest.mark.parametrize("corners", [3, 4, 7])
@pytest.mark.parametrize("size, spread", [(0.02, 2.0), (0.3, 2.0), (0.01, 0.05), (0.5, 0.05)])
def test_sweep_against_all_edges(corners, size, spread):
    from orbspan.kernels.refine import inside
    from orbspan.kernels.sweep import sweep

    rng = np.random.default_rng(corners)
    rings = polygons(rng, 150, corners, size)
    points = rings[3].mean(0) + spread * rng.normal(size=(3000, 3))
    points = np.concatenate([points, rings.mean(1), rings[:20].reshape(-1, 3) * 1.5, points[:50]])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    normals = np.cross(rings, np.roll(rings, -1, axis=1))
    # points on an edge hang on rounding
    clear = (np.abs(np.einsum("mnk,pk->mpn", normals, points)) > 1e-13).all(-1)
    want = {(p, m) for m in range(len(rings)) for p in np.flatnonzero(inside(normals[m], points) & clear[m])}
    for block in (1 << 20, 700):
        found = [(int(p), int(m)) for a, b in sweep(points, rings, block) for p, m in zip(a, b)]
        assert len(found) == len(set(found)) and {x for x in found if clear[x[1], x[0]]} == want
    assert list(sweep(points[:0], rings)) == list(sweep(points, rings[:0])) == []
