"""Points near other points, and the footprints around points, on the unit sphere.

Space is cut by a k-d tree that is fitted on a bounded sample of the points, so
dense spots get small parts.  Near: a point goes to the part it lies in and, as a
halo copy, to every part within the radius; each part is searched with a local
k-d tree by chord length.  A part that has to hold more than its share, because the
table outgrows the most parts, is searched by several tasks, each for some of its
points.  Inside: points go to their part, footprints to every part that their
bounding ball touches; a part with many footprints is split in shards that hold the
part's points each, and in a shard the footprints' edges are swept.  Tasks give
their results in batches.

The sample only places the cuts: results do not depend on it.  Points at one
place (one cell id) are searched once and joined back afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import codec, grid, polygon
from ..kernels.kdtree import Cuts, LocalTree
from ..kernels.sweep import sweep
from ..lineage import cut
from .balance import int_table
from .cover import rings_of

#: Points that place the cuts, most parts, and points of a part that one task searches for.
SAMPLE = 131_072
MOST_PARTS = 8_192
PART = 8_192
#: Keys at one place that meet in one task.
SPLIT = 1024
_POINT = "place bigint, x double, y double, z double"


def places(df: DataFrame, cell: str) -> DataFrame:
    """(place, x, y, z): the different valid cell ids of a column with their centers."""
    ids = df.select(F.col(cell).cast("bigint").alias("place")).where("place is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            values = values[codec.is_valid(values)]
            r, nested = codec.decode(values)
            p = grid.center_xyz(r, nested)
            yield pa.RecordBatch.from_arrays([pa.array(values), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], ["place", "x", "y", "z"])

    return ids.mapInArrow(run, _POINT)


def fit_cuts(points: DataFrame, part: int | None = None) -> Cuts:
    """Cuts into parts of about ``part`` points (PART), from about SAMPLE points that a hash picks."""
    n, part = points.count(), part or PART
    depth = max(0, min(math.ceil(math.log2(max(1, n) / part)), int(math.log2(MOST_PARTS))))
    if not depth:
        return Cuts(np.empty((0, 3)), 0, n)
    picked = F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < math.ceil(SAMPLE / n * (1 << 30))
    rows = points.where(picked).select("x", "y", "z").limit(2 * SAMPLE).toPandas()
    return Cuts(rows.to_numpy(dtype=np.float64), depth, n)


def _xyz(batch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=-1)


def near_places(points: DataFrame, degrees: float, cuts: Cuts | None = None) -> DataFrame:
    """(a, b) with a < b: pairs of different places at most ``degrees`` of arc apart."""
    cuts = cuts or fit_cuts(points)
    chord = 2.0 * math.sin(math.radians(degrees) / 2.0)

    shards = max(1, math.ceil(cuts.points / (2 * PART * cuts.leaves)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _xyz(batch)
            home = cuts.home(p)
            who, leaf = cuts.touched(p, np.full(len(p), chord * (1 + 1e-9)))
            mine = np.where(leaf == home[who], batch.column("place").to_numpy()[who] % shards, -1)
            who, leaf, mine = (np.repeat(x, shards) for x in (who, leaf, mine))
            shard = np.tile(np.arange(shards), len(who) // shards)
            columns = [pa.array((leaf * shards + shard).astype(np.int32)), pa.array(mine == shard)]
            columns += [c.take(pa.array(who)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["task", "own", "place", "x", "y", "z"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        p = _xyz(table)
        place = table.column("place").to_numpy()
        own = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        if len(own):
            for q, k in LocalTree(p).within(p[own], chord):
                left, right = place[own[q]], place[k]
                keep = left < right
                yield pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep])], ["a", "b"])

    copies = points.mapInArrow(spread, "task int, own boolean, place bigint, x double, y double, z double")
    return copies.repartitionById(cuts.leaves * shards, "task").groupBy("task").applyInArrow(search, "a bigint, b bigint")


def _members(df: DataFrame, key: str, cell: str) -> DataFrame:
    """(place, key): each key once, at its smallest valid cell."""
    from ..functions.cells import is_cell_id

    return (
        df.where(is_cell_id(F.col(cell)) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.col(cell)).cast("bigint").alias("place"))
    )


def near_pairs(df: DataFrame, degrees: float, key: str, cell: str, cuts: Cuts | None = None, points: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id), left < right: keys whose cell centers are at most ``degrees`` apart.

    Rows with a null key or without a valid cell id are left out, a repeated key
    counts once; keys at one place are pairs too.
    """
    members = _members(df, key, cell)
    points = points if points is not None else places(members, "place")
    pairs = near_places(points, degrees, cuts)
    left = members.select(F.col("place").alias("a"), F.col("key").alias("k1"))
    right = members.select(F.col("place").alias("b"), F.col("key").alias("k2"))
    apart = pairs.join(left, "a").join(right, "b").select("k1", "k2")
    # the keys of one place are pairs too: one side goes to all parts of the place, the other is spread over them
    many = members.groupBy("place").agg(((F.count("*") - 1) / SPLIT).cast("int").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = members.join(many, "place")
    c = shared.select("place", F.col("key").alias("k1"), F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    d = shared.select("place", F.col("key").alias("k2"), F.pmod(F.xxhash64("key"), F.col("last") + 1).cast("int").alias("part"))
    same = c.join(d, ["place", "part"]).where("k1 < k2").select("k1", "k2")
    return apart.union(same).select(F.least("k1", "k2").alias("left_id"), F.greatest("k1", "k2").alias("right_id"))


def points_in_footprints(
    points: DataFrame, footprints: DataFrame, key: str = "footprint_id", vertices: str = "vertices", cuts: Cuts | None = None, shard: int = 65_536
) -> DataFrame:
    """(place, key) where the point lies in the footprint, by the center rule of the cover.

    Footprints that break a rule are left out, a repeated key counts once.
    """
    cuts = cuts or fit_cuts(points)
    source = footprints.select(F.col(key).cast("bigint").alias("key"), F.col(vertices).alias("v")).where("key is not null")

    def spread_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, ring in polygon.normalize(*rings_of(batch.column(1)))[1]:
                middle = ring.sum(1)
                with np.errstate(all="ignore"):
                    middle = middle / np.sqrt((middle * middle).sum(-1, keepdims=True))
                least = np.einsum("mnk,mk->mn", ring, middle).min(1)
                # a cap below a hemisphere is convex and holds the edges too; others are looked for everywhere
                chord = np.where(least > 1e-6, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least)) + 1e-9, 4.0)
                who, leaf = cuts.touched(np.nan_to_num(middle), chord)
                n = ring.shape[1]
                flat = pa.array(ring[who].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(who) + 1) * n * 3).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(keys[rows][who]), lists], ["leaf", "key", "ring"])

    rings = cut(source.mapInArrow(spread_rings, "leaf int, key bigint, ring array<double>"))
    counts = dict(rings.groupBy("leaf").count().collect())
    shards = np.array([max(1, math.ceil(counts.get(k, 0) / shard)) for k in range(cuts.leaves)])
    first = np.cumsum(shards) - shards
    total = int(shards.sum())

    def to_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = cuts.home(_xyz(batch))
            many = shards[leaf]
            who = np.repeat(np.arange(len(leaf)), many)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            columns = [pa.array((first[leaf[who]] + nth).astype(np.int32))] + [c.take(pa.array(who)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["task", "id", "x", "y", "z"])

    at = F.element_at(int_table(first.tolist()), F.col("leaf") + 1)
    wide = F.element_at(int_table(shards.tolist()), F.col("leaf") + 1)
    none = F.lit(None)
    rings = rings.select((at + F.pmod(F.xxhash64("key"), wide)).cast("int").alias("task"), F.col("key").alias("id"), *(none.cast("double").alias(c) for c in "xyz"), "ring")
    placed = points.mapInArrow(to_tasks, "task int, id bigint, x double, y double, z double").withColumn("ring", none.cast("array<double>"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        left, right = table.filter(table.column("ring").is_null()), table.filter(table.column("ring").is_valid())
        p, place, key = _xyz(left), left.column("id").to_numpy(), right.column("id").to_numpy()
        rings_ = right.column("ring").combine_chunks()
        sizes = np.diff(rings_.offsets.to_numpy()) if len(rings_) else np.empty(0, np.int64)
        values = rings_.flatten().to_numpy() if len(rings_) else np.empty(0)
        begin = np.cumsum(sizes) - sizes
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            ring = values[begin[rows][:, None] + np.arange(n)].reshape(len(rows), -1, 3)
            for k, poly in sweep(p, ring):
                yield pa.RecordBatch.from_arrays([pa.array(place[k]), pa.array(key[rows[poly]])], ["place", "key"])

    return placed.union(rings).repartitionById(total, "task").groupBy("task").applyInArrow(search, "place bigint, key bigint")


def near_and_inside(targets: DataFrame, footprints: DataFrame, degrees: float, key: str = "target_id", cell: str = "cell_id") -> DataFrame:
    """(relation, left_id, right_id): ``near`` pairs of keys and ``inside`` (key, footprint)."""
    members = _members(targets, key, cell)
    points = cut(places(members, "place"))
    cuts = fit_cuts(points)
    near = near_pairs(targets, degrees, key, cell, cuts, points)
    once = footprints.select("footprint_id", "vertices").dropDuplicates(["footprint_id"])
    inside = points_in_footprints(points, once, cuts=cuts).withColumnRenamed("key", "right_id")
    inside = inside.join(members.withColumnRenamed("key", "left_id"), "place")
    return near.select(F.lit("near").alias("relation"), "left_id", "right_id").union(
        inside.select(F.lit("inside").alias("relation"), "left_id", "right_id")
    )
