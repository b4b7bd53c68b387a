import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import orbspan
from orbspan import functions as fn
from orbspan import operators as op
from orbspan import sql
from orbspan.kernels import grid
from orbspan.operators.near import near_places, places, points_in_footprints
from orbspan.sources import coverage_from_arrays, explode_batches, footprints_from_arrays, load_footprints
from orbspan.streaming import cover_stream, late_counts

from test_kernels import QUAD, xyz

SCHEMA = "footprint_id bigint, vertices array<struct<x:double,y:double,z:double>>, cell_id string"


def verts(v):
    return [Row(x=float(a), y=float(b), z=float(c)) for a, b, c in v]


def table(spark, *footprints):
    rows = [(k, None if v is None else verts(v), "clash") for k, v in footprints]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cover_forms_agree(spark):
    f = table(spark, (1, xyz(*QUAD)), (2, xyz((0, 0.1), (0.2, 0.1), (0.2, 0.2))), (1, xyz(*QUAD)))
    assert rows(op.cover_footprint(f, 3)) == [(1, 1306), (1, 1306), (1, 1328), (1, 1328)]
    assert rows(op.cover_footprint(f, 3, spread=3)) == rows(op.cover_footprint(f.repartition(3), 3))
    assert rows(op.cover_counts(f, 3)) == [(1, 2), (1, 2), (2, 0)]
    assert rows(op.cover_arrays(f, 3)) == [(1, [1306, 1328]), (1, [1306, 1328]), (2, [])]
    assert rows(op.cover_counts(f, 8))[0] == (1, 3992)
    assert op.cover_footprint(f, 8).where("footprint_id = 1").count() == 2 * 3992
    longest = op.cover_ranges(table(spark, (1, xyz((-60, -50), (60, -50), (60, 50), (-60, 50)))), 12)
    assert longest.agg(F.max(F.col("cell_last") - F.col("cell_first"))).first()[0] == (1 << 16) - 1


def test_bad_rows(spark):
    null_vertex = [*verts(xyz(*QUAD))[:3], None]
    f = table(spark, (1, xyz(*QUAD)), (2, xyz((0, 0), (1, 0))), (3, None), (4, [])).union(
        spark.createDataFrame([(5, null_vertex, ""), (6, [*verts(xyz(*QUAD))[:3], Row(x=None, y=0.0, z=1.0)], "")], SCHEMA)
    )
    assert rows(op.cover_footprint(f, 3, mode="permissive")) == [(1, 1306), (1, 1328)]
    assert rows(op.cover_counts(f, 3, mode="permissive")) == [(1, 2)]
    errors = dict(rows(op.validate_footprints(f)))
    assert errors[1] is None and "three vertices" in errors[2] and "three vertices" in errors[4]
    assert errors[3] == errors[5] == errors[6] == "Footprint or vertex is null."
    with pytest.raises(Exception, match="footprint 2: Each polygon needs at least three"):
        op.cover_footprint(f.where("footprint_id < 3"), 3).collect()
    empty = f.limit(0)
    assert rows(op.cover_footprint(empty, 3)) == rows(op.cover_counts(empty, 3)) == rows(op.validate_footprints(empty)) == []
    for bad, kind in ((2.0, TypeError), (True, TypeError), (30, ValueError), (-1, ValueError)):
        with pytest.raises(kind):
            op.cover_footprint(f, bad)
    with pytest.raises(TypeError):
        op.cover_footprint(spark.range(1).withColumnRenamed("id", "vertices").withColumn("footprint_id", F.lit(1)), 3)


def test_resolution_column(spark):
    f = table(spark, (1, xyz(*QUAD)), (2, xyz(*QUAD)), (3, xyz(*QUAD)), (4, xyz(*QUAD)))
    f = f.withColumn("r", F.element_at(F.array(F.lit(2), F.lit(3), F.lit(None).cast("int"), F.lit(30)), F.col("footprint_id").cast("int")))
    assert rows(op.cover_footprint(f, "r", mode="permissive")) == [(1, 326), (2, 1306), (2, 1328)]
    with pytest.raises(Exception, match="between 0 and 29"):
        op.cover_counts(f, "r").collect()


def test_offsets_and_import(spark, tmp_path):
    quads = np.stack([xyz(*QUAD), xyz((20, -10), (33, -10), (33, 0), (20, 0))])
    np.save(tmp_path / "f.npy", quads)
    np.savez(tmp_path / "f.npz", footprints=quads)
    for name in ("f.npy", "f.npz"):
        assert load_footprints(tmp_path / name).shape == (2, 4, 3)
    np.savez(tmp_path / "g.npz", other=quads)
    np.save(tmp_path / "h.npy", quads[0])
    for name in ("g.npz", "h.npy"):
        with pytest.raises(ValueError):
            load_footprints(tmp_path / name)
    f = footprints_from_arrays(spark, quads)
    want = orbspan.cover_footprint(quads, 4)
    cut = rows(op.coverage_offsets(op.cover_counts(f, 4)))
    assert [(a, b) for _, a, b in cut] == list(zip(want.offsets[:-1].tolist(), want.offsets[1:].tolist()))
    assert rows(op.cover_footprint(f, 4)) == rows(coverage_from_arrays(spark, want))


def test_swath(spark):
    left, right = xyz((-5, -5), (-4, 0), (-3, 5)), xyz((5, -5), (4, 0), (3, 5))
    data = [(7, 10 * k, verts([a])[0], verts([b])[0]) for k, (a, b) in enumerate(zip(left, right))]
    data += [data[1], (8, 0, None, data[0][3]), (8, 1, data[0][2], data[0][3]), (None, 0, data[0][2], data[0][3]), (7, None, data[0][2], data[0][3])]
    vec = "struct<x:double,y:double,z:double>"
    s = spark.createDataFrame(data, f"swath_id bigint, seq int, left_edge_xyz {vec}, right_edge_xyz {vec}")
    for block in (1, 10, 15, 4096):
        assert op.swath_footprints(s, block=block, mode="permissive").count() == 3
    assert rows(op.cover_swath(s, 3, mode="permissive")) == [(7, 0, 1295), (7, 10, 1328)]
    with pytest.raises(Exception, match="null"):
        op.cover_swath(s, 3).collect()
    with pytest.raises(Exception, match="at least two"):
        op.cover_swath(s.where("swath_id = 7 and seq = 0"), 3).collect()
    assert op.cover_swath(s.limit(0), 3).count() == 0


def test_columns(spark):
    ids = [16, 27, 28, 0, -3, None, 1041, 7 * 2**60 - 1, 7 * 2**60, 2**62]
    d = spark.createDataFrame([(x,) for x in ids], "c bigint")
    got = d.select("c", fn.is_cell_id("c"), fn.cell_resolution("c"), fn.nested_index("c"), fn.parent_cell("c", 1), fn.children_range("c", 4)).collect()
    assert [r[1] for r in got] == [True, True, False, False, False, False, True, True, False, True]
    assert [r[2] for r in got] == [0, 0, None, None, None, None, 3, 29, None, 29]
    assert got[6][3] == 17 and got[6][4] == 65 and tuple(got[6][5]) == (4164, 4167) and got[7][3] == 12 * 4**29 - 1
    assert got[0][4] is None
    back = d.where(fn.is_cell_id("c")).select("c", fn.encode_cell_id(fn.cell_resolution("c"), fn.nested_index("c"))).collect()
    assert all(a == b for a, b in back)
    assert tuple(spark.range(1).select(fn.nside(3), fn.pixel_count(29), fn.pixel_count(F.lit(1))).first()) == (8, 12 * 4**29, 48)
    assert spark.range(48, 49).select(fn.encode_cell_id(1, "id")).first()[0] is None
    with pytest.raises(Exception, match="out of range"):
        spark.range(48, 49).select(fn.encode_cell_id(1, "id", strict=True)).collect()
    with pytest.raises(Exception, match="not a valid packed"):
        d.select(fn.cell_resolution("c", strict=True)).collect()
    c = d.select("c", fn.centers("c").alias("p"), fn.boundaries("c").alias("b")).collect()
    assert c[6]["p"]["lon"] == pytest.approx(73.125) and len(c[6]["b"]) == 4
    assert c[2]["p"]["lon"] is None and c[2]["b"] is None and c[5]["b"] is None
    with pytest.raises(Exception, match="not a valid packed"):
        d.select(fn.centers("c", strict=True)).collect()
    x = spark.range(1).select(fn.lonlat_to_xyz(F.lit(370.0), F.lit(20.0)).alias("v")).select(fn.xyz_to_lonlat("v").alias("p")).first()[0]
    assert (x["lon"], x["lat"]) == (pytest.approx(10), pytest.approx(20))
    assert spark.range(1).select(fn.lonlat_to_xyz(F.lit(0.0), F.lit(91.0))).first()[0] is None


def test_validity_next_to_powers_of_two(spark):
    from orbspan.kernels import codec

    ids = sorted({max(-(1 << 63), min((1 << 63) - 1, (a << k) + d)) for k in range(63) for a in (1, 7, 15, 27, 28, 31) for d in (-2, -1, 0, 1) for k in (k,) if (a << k) < 1 << 63} | {0, -1, -16})
    got = spark.createDataFrame([(i,) for i in ids], "c bigint").select("c", fn.is_cell_id("c"), fn.cell_resolution("c")).collect()
    want = codec.resolution_of(np.array(ids)).tolist()
    assert [(r[0], r[1], r[2]) for r in got] == [(i, r >= 0, r if r >= 0 else None) for i, r in zip(ids, want)]


def test_sql_names(spark):
    sql.register(spark)
    table(spark, (1, xyz(*QUAD))).createOrReplaceTempView("some_footprints")
    got = spark.sql("select f.footprint_id, c.cell_id from some_footprints f, lateral cover_cells(f.vertices, 3) c")
    assert rows(got) == [(1, 1306), (1, 1328)]
    assert spark.sql("select cell_center(16).lon").first()[0] == pytest.approx(45)
    assert spark.sql("select size(cell_boundary(16))").first()[0] == 4


def test_stream_equals_batch(spark, tmp_path):
    f = table(spark, (1, xyz(*QUAD)), (2, xyz((0, 0), (1, 0))), (3, xyz(*QUAD)))
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    q = cover_stream(stream, 3).writeStream.format("memory").queryName("covered").outputMode("append").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert rows(spark.table("covered")) == rows(op.cover_footprint(f, 3, mode="permissive"))


def test_late_rows(spark, tmp_path):
    d = spark.sql("select cast(h as timestamp) as t, cell as cell_id from values ('2021-03-01 00:10:00', 16L), ('2021-03-01 00:20:00', 16L), ('2021-03-01 01:10:00', 17L) v(h, cell)")
    d.write.parquet(str(tmp_path / "in"))
    q = late_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "t", "1 hour", "2 hours").writeStream.format("memory").queryName("late")
    q = q.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert sorted((r["cell_id"], r["n"]) for r in spark.table("late").collect()) == [(16, 2), (17, 1)]


def test_batches(spark):
    schema = "batch_id bigint, footprint_ids array<bigint>, offsets array<bigint>, cell_ids array<bigint>, footprint_id int"
    good = (1, [5, 6, 7], [0, 2, 2, 3], [16, 17, 18], 0)
    data = [good, good, (2, [5], [0, 2], [16], 0), (3, [5], [1, 1], [16], 0), (4, [5, 6], [0, 2, 1], [16], 0), (5, None, None, None, 0), (None, [1], [0, 1], [16], 0), (6, [], [0], [], 0)]
    d = spark.createDataFrame(data, schema)
    assert rows(explode_batches(d)) == [(1, 5, 16), (1, 5, 17), (1, 7, 18)]
    assert explode_batches(d.limit(0)).count() == 0


def test_balanced_join_and_map(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("v"))
    left = left.union(left.where("k = 0")).withColumn("w", F.lit("same"))
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plan = op.plan_load(left, ["k"], tasks=8)
    shards = {h[0]: len(h[1]) for h in plan.heavy}
    assert shards[0] >= 4 and sum(plan.loads) == pytest.approx(left.count())
    assert max(plan.loads) < 1.6 * sum(plan.loads) / 8
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "k", how)
        for salt in ("rows", "position"):
            got = op.balanced_join(left, right, ["k"], how, plan, salt)
            assert sorted(map(tuple, got.select(got.columns[0]).collect()), key=str) == sorted(map(tuple, want.select("k").collect()), key=str)
    counted = op.balanced_map(left, ["k"], lambda p: p.assign(n=len(p))[["k", "n"]].head(1), "k bigint, n bigint", plan)
    assert sorted(map(tuple, counted.groupBy("k").agg(F.sum("n")).collect()), key=str) == sorted(map(tuple, left.groupBy("k").count().collect()), key=str)
    none = left.limit(0)
    assert op.balanced_join(none, right, ["k"]).count() == 0 and op.plan_load(none, ["k"]).heavy == []


def test_offsets_of_far_keys(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 3000))
    n = rng.integers(0, 9, len(keys))
    d = spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "footprint_id bigint, n bigint").repartition(5, "n")
    stop = np.cumsum(n)
    assert rows(op.coverage_offsets(d)) == list(zip(keys.tolist(), (stop - n).tolist(), stop.tolist()))
    assert op.coverage_offsets(d.limit(0)).count() == 0


def test_degrees_name_their_error_in_order(spark):
    from orbspan.api import cover_lonlat

    nan, good = float("nan"), [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    few, not_finite, beyond = "Each polygon needs at least three vertices.", "lon/lat inputs must be finite.", "latitude must be between -90 and 90 degrees."
    cases = [([*good, (nan, 1.0)], not_finite), ([(0.0, 91.0), (nan, 0.0), (1.0, 1.0)], beyond), ([(nan, 91.0), (0.0, 91.0)], few), ([(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)], "Polygon contains duplicate consecutive vertices.")]
    rows_ = [(k, v) for k, (v, _) in enumerate(cases)] + [(7, good), (8, None), (9, [(0.0, None), (nan, 0.0), (1.0, 1.0)])]
    d = spark.createDataFrame(rows_, "footprint_id bigint, vertices array<struct<lon:double,lat:double>>")
    errors = {r[0]: r[1] for r in op.validate_footprints(d).collect()}
    assert errors == {k: m for k, (_, m) in enumerate(cases)} | {7: None, 8: "Footprint or vertex is null.", 9: "Footprint or vertex is null."}
    assert {r[0] for r in op.cover_lonlat(d, 5, mode="permissive").collect()} == {7}
    for k, (_, message) in enumerate(cases):
        with pytest.raises(Exception, match=message):
            op.cover_lonlat(d.where(f"footprint_id = {k}"), 5).collect()
    # arrays: the first footprint of a batch that breaks a rule gives the message
    flat, offsets = np.array([*cases[2][0], *cases[0][0]]), np.array([0, 2, 6])
    with pytest.raises(ValueError, match=few):
        cover_lonlat(flat, offsets, 3)
    with pytest.raises(ValueError, match=not_finite):
        cover_lonlat(flat[2:], offsets[1:] - 2, 3)
    with pytest.raises(Exception, match=beyond):
        spark.range(1).select(fn.lonlat_to_xyz(F.lit(0.0), F.lit(91.0), strict=True)).collect()
    west = spark.range(1).select(F.struct(F.lit(-1.0).alias("x"), F.lit(-0.0).alias("y"), F.lit(0.0).alias("z")).alias("v"))
    assert west.select(fn.xyz_to_lonlat("v").lon).first()[0] == 180.0


def test_counts_with_total_keep_tasks_even(spark):
    from orbspan.operators import balance
    from orbspan.plans.core import heavy_records

    # one scope of each kind has a third of the records, and one key a tenth of the rows
    n = F.col("id")
    scope = F.when(n % 3 == 0, 7).otherwise(n % 211)
    key = F.when(n % 10 == 0, 5).when(n % 97 == 0, None).otherwise(n % 20_011)
    rows_ = spark.range(0, 60_000, 1, 6).select((n % 2).cast("int").alias("kind"), scope.alias("scope"), key.alias("key_id"))
    partial = op.partial_counts(rows_, ["kind", "scope", "key_id"], rows=4000)
    assert partial.agg(F.sum("n")).first()[0] == 60_000 and partial.where("kind = 0 and scope = 7 and key_id = 5").count() <= 6 * 3
    plan = balance.plan_load(partial, ["kind", "scope"], 16)
    assert any(len(h[2]) > 2 for h in plan.heavy)
    placed = balance.assign(partial, plan, "key_id").repartitionById(plan.tasks, "__task")
    real = [r[1] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(real) == 16 and max(real) < 2 * sorted(real)[8] and max(plan.loads) < 2 * sorted(plan.loads)[8]
    totals = partial.groupBy("kind", "scope").agg(F.sum("n").alias("total"))
    copies = balance.replicate(totals, plan).groupBy("kind", "scope").count().collect()
    wide = {tuple(h[:2]): len(set(h[2])) for h in plan.heavy}
    assert all(r["count"] == wide.get((r["kind"], r["scope"]), 1) for r in copies)
    want = rows_.groupBy("kind", "scope", "key_id").count().join(rows_.groupBy("kind", "scope").agg(F.count("*").alias("total")), ["kind", "scope"])
    got = op.counts_with_total(partial, ["kind", "scope"], "key_id", 16)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert heavy_records(partial.limit(0), 16).count() == 0


def test_lineage_is_cut_in_the_shared_folder(spark, monkeypatch):
    from orbspan import lineage

    d = lineage.cut(spark.range(5).withColumn("x", F.array(F.lit(1), F.lit(None))))
    assert sorted(map(str, d.collect())) == sorted(map(str, spark.range(5).withColumn("x", F.array(F.lit(1), F.lit(None))).collect()))
    assert all(f.startswith(("file:" + lineage.shared_folder(spark), "file://" + lineage.shared_folder(spark))) for f in d.inputFiles())


def test_near_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 3))
    v[:300] = v[0] + 0.01 * rng.normal(size=(300, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    from orbspan.kernels.kdtree import Cuts

    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "place bigint, x double, y double, z double")
    for degrees, depth in ((0.3, 0), (0.3, 4), (25.0, 3)):
        got = rows(near_places(d, degrees, Cuts(v, depth)))
        angle = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(v[:, None] - v[None], axis=2) / 2, 0, 1)))
        a, b = np.nonzero(np.triu(angle <= degrees, 1))
        assert got == sorted(zip(a.tolist(), b.tolist()))
    rings = {k: xyz(*QUAD) for k in range(2)} | {9: xyz((-45, 70), (45, 70), (135, 70), (-135, 70)), 10: xyz((-80, -60), (80, -60), (80, 60), (-80, 60))}
    f = table(spark, *rings.items(), (11, None), (12, xyz((0, 0), (1, 0))))
    for depth, shard in ((0, 65536), (3, 65536), (3, 1)):
        got = rows(points_in_footprints(d, f, cuts=Cuts(v, depth), shard=shard))
        want = []
        for k, ring in rings.items():
            normals = np.cross(ring, np.roll(ring, -1, axis=0))
            want += [(int(i), k) for i in np.flatnonzero((v @ normals.T >= -1e-14).all(1))]
        assert got == sorted(want)


def test_a_dense_spot_is_searched_by_several_tasks(spark, monkeypatch):
    from orbspan.kernels.kdtree import Cuts
    from orbspan.operators import near

    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 3)) * [4e-3, 4e-3, 0] + [0, 0, 1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "place bigint, x double, y double, z double")
    want, chord = 0, 2 * np.sin(np.radians(0.01) / 2)
    for k in range(0, len(v), 2000):
        want += int(((v[k : k + 2000, None, 0] - v[None, :, 0]) ** 2 + (v[k : k + 2000, None, 1] - v[None, :, 1]) ** 2 + (v[k : k + 2000, None, 2] - v[None, :, 2]) ** 2 <= chord**2).sum())
    for part, depth in ((8192, 2), (500, 1)):
        monkeypatch.setattr(near, "PART", part)
        found = near_places(d, 0.01, Cuts(v[::40], depth, len(v)))
        assert found.count() == found.distinct().count() == (want - len(v)) // 2 > 20_000


def test_near_pairs_of_cells(spark, monkeypatch):
    from orbspan.operators import near

    monkeypatch.setattr(near, "SPLIT", 1)

    cells = [(1, 1041, "a"), (2, 1041, "b"), (1, 1041, "a"), (3, 28, "c"), (4, None, "d"), (None, 1041, "e"), (5, 16, "f"), (6, 1 << 40 | 5, "g"), (7, 1 << 40 | 4, "h")]
    d = spark.createDataFrame(cells, "target_id bigint, cell_id bigint, place string")
    assert rows(op.near_pairs(d, 0.01, "target_id", "cell_id")) == [(1, 2), (6, 7)]
    assert rows(op.near_pairs(d.limit(0), 0.01, "target_id", "cell_id")) == []
    assert places(d, "cell_id").count() == 4
    assert np.allclose(grid.center_xyz(0, np.array([4])), [[1, 0, 0]])
