"""Queries over the test tables for every operator of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..kernels import polygon
from ..lineage import cut
from ..operators import balance, cover, near, swath
from ..sources.arrays import explode_batches, well_formed
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def micro(c):
    """Degrees as whole millionths, so that the last bits of a double don't matter."""
    return F.round(c * 1e6).cast("bigint")


@query(f"SELECT target_id, cell_id, CASE WHEN {S.is_cell('cell_id')} THEN {S.resolution('cell_id')} END AS resolution, CASE WHEN {S.is_cell('cell_id')} THEN cell_id - (CAST(16 AS BIGINT) << (2 * {S.resolution('cell_id')})) END AS nested FROM targets")
def codec_decode(spark, sf_dir):
    d = C.decode_cell_id("cell_id")
    return read(spark, sf_dir, "targets").select("target_id", "cell_id", d["resolution"].alias("resolution"), d["nested"].alias("nested"))


@query("SELECT footprint_id, resolution, CASE WHEN resolution BETWEEN 0 AND 29 AND footprint_id >= 0 AND footprint_id < (CAST(12 AS BIGINT) << (2 * resolution)) THEN (CAST(16 AS BIGINT) << (2 * resolution)) + footprint_id END AS cell_id FROM footprints")
def codec_encode(spark, sf_dir):
    f = read(spark, sf_dir, "footprints")
    return f.select("footprint_id", "resolution", C.encode_cell_id("resolution", "footprint_id").alias("cell_id"))


@query(f"SELECT instrument, CAST(count(*) FILTER ({S.is_cell('cell_id')}) AS BIGINT) AS valid, CAST(count(*) FILTER (cell_id IS NOT NULL AND NOT {S.is_cell('cell_id')}) AS BIGINT) AS invalid, CAST(count(*) AS BIGINT) AS n FROM coverage GROUP BY instrument")
def codec_valid(spark, sf_dir):
    ok = C.is_cell_id("cell_id")
    return read(spark, sf_dir, "coverage").groupBy("instrument").agg(
        F.count_if(ok).alias("valid"), F.count_if(F.col("cell_id").isNotNull() & ~ok).alias("invalid"), F.count("*").alias("n")
    )


@query(f"WITH v AS (SELECT cell_id FROM coverage WHERE {S.is_cell('cell_id')} AND cell_id >= {16 << 10}) SELECT (cell_id >> (2 * ({S.resolution('cell_id')} - 5))) AS parent, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1")
def parent_rollup(spark, sf_dir):
    up = read(spark, sf_dir, "coverage").select(C.parent_cell("cell_id", 5).alias("parent"))
    return up.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))


_IDS = f"ids AS (SELECT target_id, cell_id, {S.resolution('cell_id')} AS r, cell_id - (CAST(16 AS BIGINT) << (2 * {S.resolution('cell_id')})) AS nested FROM targets WHERE {S.is_cell('cell_id')})"
_LON, _LAT = S.lonlat()


@query(f"WITH {_IDS}, {S.spots('ids')} SELECT target_id, cell_id, CAST(round({_LON} * 1e6) AS BIGINT) AS lon, CAST(round({_LAT} * 1e6) AS BIGINT) AS lat FROM spot")
def cell_centers(spark, sf_dir):
    t = read(spark, sf_dir, "targets").where(C.is_cell_id("cell_id")).withColumn("c", C.centers("cell_id"))
    return t.select("target_id", "cell_id", micro(F.col("c.lon")).alias("lon"), micro(F.col("c.lat")).alias("lat"))


@query(f"WITH {_IDS}, {S.spots('ids', 'VALUES (0, 0.5e0, 0.5e0), (1, -0.5e0, 0.5e0), (2, -0.5e0, -0.5e0), (3, 0.5e0, -0.5e0)')} SELECT target_id, cell_id, CAST(corner AS INTEGER) AS corner, CAST(round({_LON} * 1e6) AS BIGINT) AS lon, CAST(round({_LAT} * 1e6) AS BIGINT) AS lat FROM spot")
def cell_boundaries(spark, sf_dir):
    t = read(spark, sf_dir, "targets").where(C.is_cell_id("cell_id")).withColumn("b", C.boundaries("cell_id"))
    t = t.select("target_id", "cell_id", F.posexplode("b").alias("corner", "c"))
    return t.select("target_id", "cell_id", "corner", micro(F.col("c.lon")).alias("lon"), micro(F.col("c.lat")).alias("lat"))


_FOOT = "src AS (SELECT footprint_id AS key, vertices FROM footprints)"
_COVER4 = f"WITH {_FOOT}, {S.rings('src')}, {S.cells(4)}, {S.COVERED}"


@query(f"WITH {_FOOT}, {S.rings('src')} SELECT key AS footprint_id, rid IN (SELECT rid FROM fd) AS valid FROM f0")
def valid_footprints(spark, sf_dir):
    return cover.validate_footprints(read(spark, sf_dir, "footprints")).select("footprint_id", F.col("error").isNull().alias("valid"))


@query(f"WITH {_FOOT}, {S.broken('src', polygon.MESSAGES)} SELECT error, CAST(count(*) AS BIGINT) AS n FROM said WHERE error IS NOT NULL GROUP BY error")
def invalid_footprints(spark, sf_dir):
    found = cover.validate_footprints(read(spark, sf_dir, "footprints"))
    return found.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@query(f"{_COVER4} SELECT key AS footprint_id, cell_id FROM hit")
def cover_footprints_r4(spark, sf_dir):
    return cover.cover_footprint(read(spark, sf_dir, "footprints"), 4, mode="permissive")


@query(f"{_COVER4} SELECT any_value(d.key) AS footprint_id, CAST(count(h.cell_id) AS BIGINT) AS n FROM (SELECT rid, any_value(key) AS key FROM edge GROUP BY rid) d LEFT JOIN hit h ON h.rid = d.rid GROUP BY d.rid")
def cover_counts_r4(spark, sf_dir):
    return cover.cover_counts(read(spark, sf_dir, "footprints"), 4, mode="permissive")


@query(f"WITH {_FOOT}, {S.rings('src')}, {S.cells(3)}, {S.COVERED} SELECT any_value(d.key) AS footprint_id, CASE WHEN count(h.cell_id) = 0 THEN CAST([] AS BIGINT[]) ELSE list(h.cell_id ORDER BY h.cell_id) END AS cell_ids FROM (SELECT rid, any_value(key) AS key FROM edge GROUP BY rid) d LEFT JOIN hit h ON h.rid = d.rid GROUP BY d.rid")
def cover_arrays_r3(spark, sf_dir):
    return cover.cover_arrays(read(spark, sf_dir, "footprints"), 3, mode="permissive")


_MIXED = " UNION ALL ".join(f"SELECT CAST(i AS BIGINT) AS nested, {r} AS r FROM range({12 << 2 * r}) t(i)" for r in range(7))


@query(f"""WITH {_FOOT}, {S.rings('src')}, c0 AS ({_MIXED}), {S.spots('c0')}, cell AS (SELECT r, s * cos(phi) AS x, s * sin(phi) AS y, z FROM spot),
hit AS (SELECT e.rid, c.x, c.y, c.z FROM edge e JOIN cell c ON c.r = e.key % 7 GROUP BY e.rid, c.x, c.y, c.z HAVING min(e.nx * c.x + e.ny * c.y + e.nz * c.z) >= -1e-14)
SELECT any_value(d.key) AS footprint_id, CAST(count(h.x) AS BIGINT) AS n FROM (SELECT rid, any_value(key) AS key FROM edge GROUP BY rid HAVING any_value(key) IS NOT NULL) d LEFT JOIN hit h ON h.rid = d.rid GROUP BY d.rid""")
def cover_counts_mixed(spark, sf_dir):
    """Cells of each footprint where every row has a resolution of its own, 0 to 6 by its id."""
    f = read(spark, sf_dir, "footprints").where("footprint_id is not null")
    return cover.cover_counts(f.withColumn("level", F.pmod("footprint_id", F.lit(7)).cast("int")), "level", mode="permissive")


@query()
def cover_counts_native(spark, sf_dir):
    """Cells of each footprint at its own resolution, without listing them."""
    return cover.cover_counts(read(spark, sf_dir, "footprints"), "resolution", mode="permissive")


@query()
def cover_footprints_native(spark, sf_dir):
    return cover.cover_footprint(read(spark, sf_dir, "footprints"), "resolution", mode="permissive")


@query()
def cover_arrays_native(spark, sf_dir):
    return cover.cover_arrays(read(spark, sf_dir, "footprints"), "resolution", mode="permissive")


@query()
def revisit_count_native(spark, sf_dir):
    return cover_footprints_native(spark, sf_dir).groupBy("cell_id").agg(F.count("*").alias("visits"))


@query()
def union_cover_native(spark, sf_dir):
    return cover_footprints_native(spark, sf_dir).select("cell_id").distinct()


@query()
def coverage_offsets_native(spark, sf_dir):
    """Each footprint once: of the copies of a key, the usable one with the fewest cells."""
    counts = cover.cover_counts(read(spark, sf_dir, "footprints"), "resolution", mode="permissive")
    return cover.coverage_offsets(counts.groupBy("footprint_id").agg(F.min("n").alias("n")))


@query(f"{_COVER4} SELECT cell_id, CAST(count(*) AS BIGINT) AS visits FROM hit GROUP BY cell_id")
def revisit_count_r4(spark, sf_dir):
    found = cover.cover_footprint(read(spark, sf_dir, "footprints"), 4, mode="permissive")
    return found.groupBy("cell_id").agg(F.count("*").alias("visits"))


@query(f"{_COVER4} SELECT DISTINCT cell_id FROM hit")
def union_cover_r4(spark, sf_dir):
    return cover.cover_footprint(read(spark, sf_dir, "footprints"), 4, mode="permissive").select("cell_id").distinct()


@query(f"{_COVER4}, once AS (SELECT key, any_value(rid) AS rid FROM edge GROUP BY key), cnt AS (SELECT o.key, CAST(count(h.cell_id) AS BIGINT) AS n FROM once o LEFT JOIN hit h ON h.rid = o.rid GROUP BY o.key) SELECT key AS footprint_id, CAST(sum(n) OVER (ORDER BY key) - n AS BIGINT) AS offset_start, CAST(sum(n) OVER (ORDER BY key) AS BIGINT) AS offset_stop FROM cnt")
def coverage_offsets_r4(spark, sf_dir):
    once = read(spark, sf_dir, "footprints").select("footprint_id", "vertices").dropDuplicates(["footprint_id"])
    return cover.coverage_offsets(cover.cover_counts(once, 4, mode="permissive"))


def _supplier_sql() -> str:
    lon, lat = "(CAST((s_suppkey * 37) % 360 AS DOUBLE) - 179.3e0", "(CAST((s_suppkey * 23) % 121 AS DOUBLE) - 60.2e0"
    vec = []
    for a, b in ((-6.1, -5.3), (6.1, -5.3), (6.1, 5.3), (-6.1, 5.3)):
        x, y = f"radians({lon} + ({a}e0)))", f"radians({lat} + ({b}e0)))"
        vec.append(f"{{'x': cos({y}) * cos({x}), 'y': cos({y}) * sin({x}), 'z': sin({y})}}")
    return f"src AS (SELECT s_suppkey AS key, [{', '.join(vec)}] AS vertices FROM supplier)"


@query(f"WITH {_supplier_sql()}, {S.rings('src')}, {S.cells(3)}, {S.COVERED} SELECT any_value(d.key) AS s_suppkey, CAST(count(h.cell_id) AS BIGINT) AS n FROM (SELECT rid, any_value(key) AS key FROM edge GROUP BY rid) d LEFT JOIN hit h ON h.rid = d.rid GROUP BY d.rid")
def cover_quads_r3(spark, sf_dir):
    return cover.cover_counts(supplier_quads(spark, sf_dir), 3, key="s_suppkey")


@query(f"WITH {_supplier_sql()}, {S.rings('src')}, {S.cells(3)}, {S.COVERED} SELECT key AS s_suppkey, cell_id FROM hit")
def cover_lonlat_r3(spark, sf_dir):
    return cover.cover_lonlat(supplier_lonlat(spark, sf_dir), 3, key="s_suppkey")


def supplier_lonlat(spark, sf_dir):
    """A quadrilateral in degrees around a place made from each supplier's key."""
    s = read(spark, sf_dir, "supplier")
    lon, lat = (F.col("s_suppkey") * 37) % 360 - F.lit(179.3), (F.col("s_suppkey") * 23) % 121 - F.lit(60.2)
    corners = [F.struct((lon + a).alias("lon"), (lat + b).alias("lat")) for a, b in ((-6.1, -5.3), (6.1, -5.3), (6.1, 5.3), (-6.1, 5.3))]
    return s.select("s_suppkey", F.array(*corners).alias("vertices"))


def supplier_quads(spark, sf_dir):
    s = supplier_lonlat(spark, sf_dir)
    return s.select("s_suppkey", cover.lonlat_vertices(s["vertices"]).alias("vertices"))


@query("SELECT DISTINCT resolution, CASE WHEN resolution BETWEEN 0 AND 29 THEN CAST(1 AS BIGINT) << resolution END AS nside, CASE WHEN resolution BETWEEN 0 AND 29 THEN CAST(12 AS BIGINT) << (2 * resolution) END AS pixels FROM footprints")
def codec_sizes(spark, sf_dir):
    levels = read(spark, sf_dir, "footprints").select("resolution").distinct()
    return levels.select("resolution", C.nside("resolution").cast("bigint").alias("nside"), C.pixel_count("resolution").alias("pixels"))


_DEGREES = "CAST((s_suppkey * 37) % 720 AS DOUBLE) - 300.3e0 AS lon, CAST((s_suppkey * 23) % 211 AS DOUBLE) - 105.2e0 AS lat"


@query(f"SELECT s_suppkey, CASE WHEN abs(lat) <= 90 THEN CAST(round(cos(radians(lat)) * cos(radians(lon)) * 1e6) AS BIGINT) END AS x, CASE WHEN abs(lat) <= 90 THEN CAST(round(cos(radians(lat)) * sin(radians(lon)) * 1e6) AS BIGINT) END AS y, CASE WHEN abs(lat) <= 90 THEN CAST(round(sin(radians(lat)) * 1e6) AS BIGINT) END AS z FROM (SELECT s_suppkey, {_DEGREES} FROM supplier)")
def lonlat_vectors(spark, sf_dir):
    """Unit vectors of degrees; a latitude beyond the poles gives null, longitudes are unbounded."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 720 - F.lit(300.3)).alias("lon"), ((F.col("s_suppkey") * 23) % 211 - F.lit(105.2)).alias("lat"))
    v = C.lonlat_to_xyz("lon", "lat")
    return s.select("s_suppkey", *(micro(v[c]).alias(c) for c in "xyz"))


@query("""WITH v AS (SELECT s_suppkey, s_suppkey % 9 AS kind FROM supplier)
SELECT s_suppkey, CASE WHEN kind IN (1, 5) THEN 'Each polygon needs at least three vertices.' WHEN kind = 2 THEN 'lon/lat inputs must be finite.' WHEN kind IN (3, 6) THEN 'latitude must be between -90 and 90 degrees.'
  WHEN kind = 4 THEN 'Polygon contains duplicate consecutive vertices.' WHEN kind = 7 THEN 'Footprint or vertex is null.' END AS error FROM v""")
def lonlat_messages(spark, sf_dir):
    """Triangles in degrees with one fault by the supplier's key, and the message of the first rule they break."""
    s = read(spark, sf_dir, "supplier").withColumn("kind", F.col("s_suppkey") % 9)
    nan, at = F.lit(float("nan")), lambda lon, lat: F.struct(F.lit(lon).cast("double").alias("lon"), F.lit(lat).cast("double").alias("lat"))
    a, b, c = at(0.0, 0.0), at(4.0, 0.0), at(4.0, 4.0)
    wrong = [F.array(a, b), F.array(a, at(nan, 95.0), c), F.array(at(1.0, 91.0), at(nan, 0.0), c), F.array(a, a, c), F.array(at(nan, 0.0)), F.array(a, at(0.0, -90.5), at(0.0, -90.5)), F.array(a, b, at(None, 1.0))]
    vertices = F.array(a, b, c)
    for kind, v in enumerate(wrong, 1):
        vertices = F.when(F.col("kind") == kind, v).otherwise(vertices)
    return cover.validate_footprints(s.select("s_suppkey", vertices.alias("vertices")), key="s_suppkey")


_SWATH = """w0 AS (SELECT swath_id, seq, any_value(left_edge_xyz) AS l, any_value(right_edge_xyz) AS r FROM swath_samples WHERE swath_id IS NOT NULL AND seq IS NOT NULL GROUP BY swath_id, seq),
w1 AS (SELECT swath_id, seq, l, r, lead(l) OVER w AS l2, lead(r) OVER w AS r2, lead(seq) OVER w AS nx FROM w0 WINDOW w AS (PARTITION BY swath_id ORDER BY seq)),
src AS (SELECT {'swath_id': swath_id, 'seq': seq} AS key, [l, r, r2, l2] AS vertices FROM w1 WHERE nx IS NOT NULL)"""


@query(f"WITH {_SWATH}, {S.rings('src')}, {S.cells(4)}, {S.COVERED} SELECT key.swath_id AS swath_id, key.seq AS seq, cell_id FROM hit")
def cover_swath_r4(spark, sf_dir):
    return swath.cover_swath(read(spark, sf_dir, "swath_samples"), 4, mode="permissive")


@query(f"WITH {_SWATH}, {S.rings('src')}, {S.cells(4)}, {S.COVERED} SELECT CAST(d.key.swath_id AS BIGINT) AS swath_id, CAST(d.key.seq AS INTEGER) AS seq, CAST(count(h.cell_id) AS BIGINT) AS n FROM (SELECT rid, any_value(key) AS key FROM edge GROUP BY rid) d LEFT JOIN hit h ON h.rid = d.rid GROUP BY d.rid, d.key.swath_id, d.key.seq")
def swath_counts_r4(spark, sf_dir):
    quads = swath.swath_footprints(read(spark, sf_dir, "swath_samples"), mode="permissive")
    keyed = quads.select(F.struct("swath_id", "seq").alias("key"), "vertices")
    return cover.cover_counts(keyed, 4, key="key", mode="permissive").select("key.swath_id", "key.seq", "n")


@query("WITH v AS (SELECT swath_id, seq, left_edge_xyz AS v FROM swath_samples WHERE abs(sqrt(left_edge_xyz.x * left_edge_xyz.x + left_edge_xyz.y * left_edge_xyz.y + left_edge_xyz.z * left_edge_xyz.z) - 1) < 1e-9) SELECT swath_id, seq, CAST(round(degrees(atan2(v.y, v.x)) * 1e6) AS BIGINT) AS lon, CAST(round(degrees(atan2(v.z, sqrt(v.x * v.x + v.y * v.y))) * 1e6) AS BIGINT) AS lat FROM v")
def swath_edge_lonlat(spark, sf_dir):
    v = F.col("left_edge_xyz")
    w = F.sqrt(v.x * v.x + v.y * v.y + v.z * v.z)
    s = read(spark, sf_dir, "swath_samples").where((F.abs(w - 1) < 1e-9) & ~F.isnan(w))
    d = C.xyz_to_lonlat("left_edge_xyz")
    return s.select("swath_id", "seq", micro(d["lon"]).alias("lon"), micro(d["lat"]).alias("lat"))


@query(f"WITH {S.BATCHES} SELECT batch_id, footprint_id, unnest(cells) AS cell_id FROM slices")
def batch_cells(spark, sf_dir):
    return explode_batches(read(spark, sf_dir, "coverage_batches"))


_P3_IDS = f"ids AS (SELECT target_id, min(cell_id) AS cell_id, {S.resolution('min(cell_id)')} AS r, min(cell_id) - (CAST(16 AS BIGINT) << (2 * {S.resolution('min(cell_id)')})) AS nested FROM targets WHERE target_id IS NOT NULL AND {S.is_cell('cell_id')} GROUP BY target_id)"


@query(f"""WITH {_P3_IDS}, {S.spots('ids')}, pt AS (SELECT target_id, s * cos(phi) AS x, s * sin(phi) AS y, z FROM spot),
src AS (SELECT footprint_id AS key, any_value(vertices) AS vertices FROM footprints WHERE footprint_id IS NOT NULL GROUP BY footprint_id), {S.rings('src')}
SELECT 'near' AS relation, a.target_id AS left_id, b.target_id AS right_id FROM pt a JOIN pt b ON a.target_id < b.target_id AND abs(a.z - b.z) < 0.0002
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4 * sin(radians(0.005e0)) * sin(radians(0.005e0))
UNION ALL SELECT 'inside', p.target_id, e.key FROM pt p, edge e GROUP BY p.target_id, e.key HAVING min(e.nx * p.x + e.ny * p.y + e.nz * p.z) >= -1e-14""")
def p3_found(spark, sf_dir):
    return near.near_and_inside(read(spark, sf_dir, "targets"), read(spark, sf_dir, "footprints"), 0.01)


@query(f"""WITH v AS (SELECT strftime(covered_at, '%Y-%m-%d') AS day, cell_id FROM coverage WHERE covered_at IS NOT NULL AND {S.is_cell('cell_id')}),
c AS (SELECT day, cell_id, count(*) AS n FROM v GROUP BY day, cell_id), t AS (SELECT day, count(*) AS n FROM v GROUP BY day), {S.BATCHES}
SELECT 'cell' AS kind, day AS scope, cell_id AS key_id FROM c JOIN t USING (day) WHERE c.n * 20 >= t.n
UNION ALL SELECT DISTINCT 'footprint', CAST(batch_id AS VARCHAR), footprint_id FROM slices WHERE entries > 0 AND n * 2 >= entries""")
def p5_found(spark, sf_dir):
    return heavy_shares(read(spark, sf_dir, "coverage"), read(spark, sf_dir, "coverage_batches"))


def heavy_shares(coverage: DataFrame, batches: DataFrame) -> DataFrame:
    """Cells with at least a twentieth of a day's rows, footprints with half of a batch's entries.

    The rows of coverage become partial counts per (day, cell) where they are read;
    these and the slices of the batches are the records.  Records are joined with
    their scope's total by fragment and replicate: scopes are packed on tasks by
    their records, large ones split in shards, and a total goes to the shards of
    its scope only.  A batch without entries has no case.  Null keys are no keys.
    """
    return heavy_records(share_records(coverage, batches))


def share_records(coverage: DataFrame, batches: DataFrame) -> DataFrame:
    """(kind, scope, key_id, n): kind 0 has partial counts of cells by day number, kind 1 entries of footprints by batch."""
    rows = coverage.where(F.col("covered_at").isNotNull() & C.is_cell_id("cell_id")).select(
        F.unix_date(F.to_date("covered_at")).cast("bigint").alias("scope"), F.col("cell_id").alias("key_id")
    )
    cells = balance.partial_counts(rows, ["scope", "key_id"]).select(F.lit(0).alias("kind"), "scope", "key_id", "n")
    o = F.col("offsets")
    sizes = F.transform(F.sequence(F.lit(1), F.size(o) - 1), lambda k: F.get(o, k) - F.get(o, k - 1))
    slices = batches.where(well_formed() & F.col("batch_id").isNotNull() & (F.size("footprint_ids") > 0)).select(
        F.col("batch_id").alias("scope"), F.arrays_zip(F.col("footprint_ids").alias("key"), sizes.alias("n")).alias("s")
    )
    slices = slices.dropDuplicates(["scope"]).select("scope", F.explode("s").alias("s"))
    return cut(cells.union(slices.select(F.lit(1), "scope", F.col("s.key"), F.col("s.n"))))


def heavy_records(records: DataFrame, tasks: int | None = None) -> DataFrame:
    joined = balance.counts_with_total(records, ["kind", "scope"], "key_id", tasks)
    enough = F.col("n") * F.when(F.col("kind") == 0, 20).otherwise(2) >= F.col("total")
    found = joined.where((F.col("total") > 0) & enough & F.col("key_id").isNotNull())
    day = F.date_from_unix_date(F.col("scope").cast("int")).cast("string")
    return found.select(
        F.when(F.col("kind") == 0, "cell").otherwise("footprint").alias("kind"),
        F.when(F.col("kind") == 0, day).otherwise(F.col("scope").cast("string")).alias("scope"),
        "key_id",
    )
