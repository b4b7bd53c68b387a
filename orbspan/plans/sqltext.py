"""SQL building blocks for the oracles: the same definitions, by brute force."""

from __future__ import annotations


def is_cell(c: str) -> str:
    return "(" + " OR ".join(f"({c} >= {16 << 2 * r} AND {c} < {28 << 2 * r})" for r in range(30)) + ")"


def resolution(c: str) -> str:
    """Resolution of a valid id."""
    return "CAST(" + " + ".join(f"CASE WHEN {c} >= {16 << 2 * r} THEN 1 ELSE 0 END" for r in range(1, 30)) + " AS INTEGER)"


def _even_bits(n: str) -> str:
    return "(" + " + ".join(f"((({n} >> {2 * k}) & 1) << {k})" for k in range(29)) + ")"


def spots(source: str, offsets: str = "VALUES (0, 0.0e0, 0.0e0)") -> str:
    """CTEs ending in ``spot(<columns of source>, corner, z, s, phi)``; source has r and nested."""
    return f"""
off(corner, dx, dy) AS ({offsets}),
g0 AS (SELECT s.*, corner, dx, dy, nested >> (2 * r) AS face, nested & ((CAST(1 AS BIGINT) << (2 * r)) - 1) AS ins,
       CAST(CAST(1 AS BIGINT) << r AS DOUBLE) AS ns FROM {source} s, off),
g1 AS (SELECT *, ({_even_bits('ins')} + (0.5e0 + dx)) / ns AS gx, ({_even_bits('(ins >> 1)')} + (0.5e0 + dy)) / ns AS gy FROM g0),
g2 AS (SELECT *, 2.0e0 + (face // 4) - gx - gy AS jr, 2 * (face % 4) + CASE WHEN face BETWEEN 4 AND 7 THEN 0 ELSE 1 END AS jp FROM g1),
g3 AS (SELECT *, CASE WHEN jr < 1 THEN jr WHEN jr > 3 THEN 4.0e0 - jr ELSE 1.0e0 END AS nr FROM g2),
g4 AS (SELECT *, CASE WHEN jr < 1 THEN 1.0e0 - nr * nr / 3.0e0 WHEN jr > 3 THEN nr * nr / 3.0e0 - 1.0e0 ELSE (2.0e0 - jr) * (2.0e0 / 3.0e0) END AS z,
       CASE WHEN nr > 0 THEN (pi() / 4.0e0) * (jp * nr + gx - gy) / nr ELSE 0.0e0 END AS phi FROM g3),
spot AS (SELECT *, CASE WHEN jr < 1 OR jr > 3 THEN sqrt((nr * nr / 3.0e0) * (2.0e0 - nr * nr / 3.0e0)) ELSE sqrt((1.0e0 - z) * (1.0e0 + z)) END AS s FROM g4)"""


def cells(r: int) -> str:
    """CTEs ending in ``cell(cell_id, x, y, z)``: all centers of a resolution."""
    return f"""
c0 AS (SELECT CAST(i AS BIGINT) AS nested, {r} AS r FROM range({12 << 2 * r}) t(i)),
{spots('c0')},
cell AS (SELECT nested | {16 << 2 * r} AS cell_id, s * cos(phi) AS x, s * sin(phi) AS y, z FROM spot)"""


def lonlat(z="z", s="s", phi="phi") -> tuple[str, str]:
    lon = f"CASE WHEN {s} = 0 THEN 0.0e0 WHEN degrees(atan2({s} * sin({phi}), {s} * cos({phi}))) <= -180 THEN 180.0e0 ELSE degrees(atan2({s} * sin({phi}), {s} * cos({phi}))) END"
    return lon, f"degrees(atan2({z}, {s}))"


def rings(source: str) -> str:
    """CTEs ending in ``edge(rid, key, nx, ny, nz)`` of the footprints that keep all rules.

    ``source`` is a CTE or table of (key, vertices); rid tells its rows apart.
    """
    return f"""
f0 AS (SELECT row_number() OVER () AS rid, key, vertices FROM {source}),
f1 AS (SELECT rid, key, unnest(vertices) AS v, generate_subscripts(vertices, 1) AS i, len(vertices) AS n FROM f0 WHERE len(vertices) >= 3),
f2 AS (SELECT rid, key, i, n, v.x AS x, v.y AS y, v.z AS z, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS w FROM f1),
f3 AS (SELECT rid FROM f2 GROUP BY rid HAVING bool_and(coalesce(isfinite(x) AND isfinite(y) AND isfinite(z) AND w > 1e-15 AND abs(w - 1) <= 1e-6, false))),
f4 AS (SELECT rid, key, i, n, x / w AS x, y / w AS y, z / w AS z FROM f2 JOIN f3 USING (rid)),
f5 AS (SELECT a.rid, a.n - CASE WHEN abs(a.x - b.x) < 1e-12 AND abs(a.y - b.y) < 1e-12 AND abs(a.z - b.z) < 1e-12 THEN 1 ELSE 0 END AS m
       FROM f4 a JOIN f4 b ON a.rid = b.rid AND a.i = 1 AND b.i = b.n),
f6 AS (SELECT rid, key, i, m, x, y, z FROM f4 JOIN f5 USING (rid) WHERE i <= m AND m >= 3),
f7 AS (SELECT DISTINCT a.rid FROM f6 a JOIN f6 b ON a.rid = b.rid AND a.i < b.i
       WHERE abs(a.x - b.x) < 1e-12 AND abs(a.y - b.y) < 1e-12 AND abs(a.z - b.z) < 1e-12),
f8 AS (SELECT a.rid, a.key, a.i, a.m, a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz
       FROM f6 a JOIN f6 b ON a.rid = b.rid AND b.i = a.i % a.m + 1 WHERE a.rid NOT IN (SELECT rid FROM f7)),
f9 AS (SELECT rid, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM f6 GROUP BY rid),
fa AS (SELECT rid, sum(nx * sx + ny * sy + nz * sz) / any_value(sqrt(sx * sx + sy * sy + sz * sz)) AS turn
       FROM f8 JOIN f9 USING (rid) GROUP BY rid HAVING any_value(sqrt(sx * sx + sy * sy + sz * sz)) > 1e-15),
fb AS (SELECT rid, key, i, sign(turn) * nx AS nx, sign(turn) * ny AS ny, sign(turn) * nz AS nz FROM f8 JOIN fa USING (rid) WHERE abs(turn) > 1e-14),
fc AS (SELECT b.rid, b.i, min(nx * x + ny * y + nz * z) AS low, max(nx * x + ny * y + nz * z) AS high, any_value(sqrt(nx * nx + ny * ny + nz * nz)) AS w
       FROM fb b JOIN f6 v ON b.rid = v.rid GROUP BY b.rid, b.i),
fd AS (SELECT rid FROM fc GROUP BY rid HAVING bool_and(w > 1e-15 AND low >= -1e-14 AND high > 1e-14)),
edge AS (SELECT rid, key, nx, ny, nz FROM fb JOIN fd USING (rid))"""


def broken(source: str, messages) -> str:
    """CTEs ending in ``said(rid, key, error)``: the message of the first rule that each row breaks, in the order of the rules; null for good ones."""
    case = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(messages) if m)
    same = "abs(a.x - b.x) < 1e-12 AND abs(a.y - b.y) < 1e-12 AND abs(a.z - b.z) < 1e-12"
    return f"""
e0 AS (SELECT row_number() OVER () AS rid, key, vertices FROM {source}),
e1 AS (SELECT rid, unnest(vertices) AS v, generate_subscripts(vertices, 1) AS i FROM e0 WHERE len(vertices) > 0),
e2 AS (SELECT rid, i, v.x AS x, v.y AS y, v.z AS z, v IS NULL OR v.x IS NULL OR v.y IS NULL OR v.z IS NULL AS gone, sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS w FROM e1),
e3 AS (SELECT rid, i, x, y, z, w, gone, CASE WHEN NOT (isfinite(x) AND isfinite(y) AND isfinite(z)) THEN 2 WHEN w <= 1e-15 THEN 3 WHEN abs(w - 1) > 1e-6 THEN 4 ELSE 0 END AS kind FROM e2),
e4 AS (SELECT rid, bool_or(gone) AS gone, arg_min(kind, i) FILTER (kind <> 0) AS kind FROM e3 GROUP BY rid),
e5 AS (SELECT e0.rid, e0.key, CASE WHEN vertices IS NULL OR e4.gone THEN 12 WHEN len(vertices) < 3 THEN 1 WHEN e4.kind IS NOT NULL THEN e4.kind ELSE 0 END AS code, len(vertices) AS n FROM e0 LEFT JOIN e4 USING (rid)),
u0 AS (SELECT e3.rid, i, n, x / w AS x, y / w AS y, z / w AS z FROM e3 JOIN e5 USING (rid) WHERE code = 0),
u1 AS (SELECT a.rid, a.n - CASE WHEN {same} THEN 1 ELSE 0 END AS m FROM u0 a JOIN u0 b ON a.rid = b.rid AND a.i = 1 AND b.i = b.n),
u2 AS (SELECT u0.rid, i, m, x, y, z FROM u0 JOIN u1 USING (rid) WHERE i <= m AND m >= 3),
u3 AS (SELECT a.rid, min(CASE WHEN b.i = a.i + 1 OR (a.i = 1 AND b.i = b.m) THEN 6 ELSE 7 END) AS code FROM u2 a JOIN u2 b ON a.rid = b.rid AND a.i < b.i WHERE {same} GROUP BY a.rid),
u4 AS (SELECT a.rid, a.i, a.m, a.y * b.z - a.z * b.y AS nx, a.z * b.x - a.x * b.z AS ny, a.x * b.y - a.y * b.x AS nz
       FROM u2 a JOIN u2 b ON a.rid = b.rid AND b.i = a.i % a.m + 1 WHERE a.rid NOT IN (SELECT rid FROM u3)),
u5 AS (SELECT rid, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM u2 GROUP BY rid),
u6 AS (SELECT rid, arg_min(nx, i) FILTER (nx * nx + ny * ny + nz * nz > 1e-30) AS fx, arg_min(ny, i) FILTER (nx * nx + ny * ny + nz * nz > 1e-30) AS fy,
       arg_min(nz, i) FILTER (nx * nx + ny * ny + nz * nz > 1e-30) AS fz FROM u4 GROUP BY rid),
u7 AS (SELECT rid, sqrt(sx * sx + sy * sy + sz * sz) <= 1e-15 AS level, CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) > 1e-15 THEN sx ELSE fx END AS ax,
       CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) > 1e-15 THEN sy ELSE fy END AS ay, CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) > 1e-15 THEN sz ELSE fz END AS az FROM u5 JOIN u6 USING (rid)),
u8 AS (SELECT u4.rid, sum(nx * ax + ny * ay + nz * az) / any_value(sqrt(ax * ax + ay * ay + az * az)) AS turn, any_value(level AND ax IS NULL) AS point FROM u4 JOIN u7 USING (rid) GROUP BY u4.rid),
u9 AS (SELECT u4.rid, CASE WHEN turn < 0 THEN (m + m - 1 - i) % m ELSE i - 1 END AS k, sign(turn) * nx AS nx, sign(turn) * ny AS ny, sign(turn) * nz AS nz FROM u4 JOIN u8 USING (rid) WHERE abs(turn) > 1e-14),
ua AS (SELECT u9.rid, k, any_value(sqrt(nx * nx + ny * ny + nz * nz)) AS w, min(nx * x + ny * y + nz * z) AS low, max(nx * x + ny * y + nz * z) AS high FROM u9 JOIN u2 USING (rid) GROUP BY u9.rid, k),
ub AS (SELECT rid, k, CASE WHEN w <= 1e-15 THEN 10 WHEN low < -1e-14 THEN 11 WHEN high > 1e-14 THEN 0 ELSE 8 END AS kind FROM ua),
uc AS (SELECT rid, coalesce(arg_min(kind, k) FILTER (kind <> 0), 0) AS code FROM ub GROUP BY rid),
ud AS (SELECT e5.rid, e5.key, CASE WHEN e5.code <> 0 THEN e5.code WHEN u1.m < 3 THEN 5 WHEN u3.code IS NOT NULL THEN u3.code WHEN u8.point THEN 8 WHEN uc.code IS NULL THEN 9 ELSE uc.code END AS code
       FROM e5 LEFT JOIN u1 USING (rid) LEFT JOIN u3 USING (rid) LEFT JOIN u8 USING (rid) LEFT JOIN uc USING (rid)),
said AS (SELECT rid, key, CASE code {case} END AS error FROM ud)"""


COVERED = """
hit AS (SELECT e.rid, any_value(e.key) AS key, c.cell_id FROM edge e, cell c GROUP BY e.rid, c.cell_id HAVING min(e.nx * c.x + e.ny * c.y + e.nz * c.z) >= -1e-14)"""

BATCHES = """
b0 AS (SELECT batch_id, any_value(footprint_ids) AS footprint_ids, any_value(offsets) AS offsets, any_value(cell_ids) AS cell_ids FROM coverage_batches
       WHERE batch_id IS NOT NULL AND len(offsets) = len(footprint_ids) + 1 AND offsets[1] = 0 AND offsets[len(offsets)] = len(cell_ids) AND list_sort(offsets) = offsets GROUP BY batch_id),
b1 AS (SELECT batch_id, unnest(footprint_ids) AS footprint_id, generate_subscripts(footprint_ids, 1) AS k, offsets, cell_ids FROM b0),
slices AS (SELECT batch_id, footprint_id, len(cell_ids) AS entries, offsets[k + 1] - offsets[k] AS n, cell_ids[offsets[k] + 1 : offsets[k + 1]] AS cells FROM b1)"""
