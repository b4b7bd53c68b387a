"""Cells whose center lies in each footprint, as DataFrame operators.

Input: one row per footprint with a key column and ``vertices
ARRAY<STRUCT<x,y,z>>``; only those two columns (and a resolution column, if one
is named) reach Python.  Rows are independent, so there is no shuffle; the kernel
returns ranges of consecutive ids, which the JVM expands.

Defined results: a row counts by itself, repeated keys give repeated cells; a
footprint that covers no center gives no row in the cell form and 0 in the
counts; an empty table gives an empty result.  A footprint that breaks a rule
stops the query in ``strict`` mode, with the key in the message, and is left out
(or reported by ``validate_footprints``) in ``permissive`` mode; null footprints,
vertices or coordinates count as broken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..api import as_resolution
from ..kernels import codec, polygon, refine
from ..lineage import cut

# Longest range in one row: bounds the array that sequence() builds.
LONGEST = 1 << 16
_BAD_RESOLUTION = len(polygon.MESSAGES)


def rings_of(column, fields: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat vertices, offsets, null rows) of an Arrow list<struct<x,y,z>> column, or list<struct<lon,lat>>."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    values = column.flatten()
    parts, missing = [], np.zeros(len(values), dtype=bool)
    for axis in range(fields):
        part = pc.struct_field(values, axis)
        missing |= pc.is_null(part).to_numpy(zero_copy_only=False)
        parts.append(pc.fill_null(part, 0.0).to_numpy(zero_copy_only=False))
    null = pc.is_null(column).to_numpy(zero_copy_only=False).copy()
    if missing.any():
        null[np.searchsorted(offsets, np.flatnonzero(missing), side="right") - 1] = True
    return np.stack(parts, axis=-1) if len(values) else np.empty((0, fields)), offsets, null


def _messages(codes: np.ndarray) -> list[str | None]:
    table = (*polygon.MESSAGES, codec.BAD_RESOLUTION)
    return [table[k] for k in codes.tolist()]


def _work(batch: pa.RecordBatch, resolution: int | None, strict: bool):
    """(codes, (row, first, last) blocks) of one batch: key, vertices[, resolution]."""
    if batch.schema.field(1).type.value_type.num_fields == 2:
        codes, rings = polygon.normalize_degrees(*rings_of(batch.column(1), 2))
    else:
        codes, rings = polygon.normalize(*rings_of(batch.column(1)))
    if resolution is None:
        wanted = pc.fill_null(pc.cast(batch.column(2), pa.int64()), -1).to_numpy(zero_copy_only=False)
        codes[(codes == 0) & ((wanted < 0) | (wanted > codec.MAX_RESOLUTION))] = _BAD_RESOLUTION
    if strict and codes.any():
        at = int(np.flatnonzero(codes)[0])
        raise ValueError(f"footprint {batch.column(0)[at].as_py()}: {_messages(codes[at : at + 1])[0]}")

    def blocks():
        for rows, v in rings:
            levels = np.full(len(rows), resolution) if resolution is not None else wanted[rows]
            for r in np.unique(levels[codes[rows] == 0]):
                pick = np.flatnonzero((levels == r) & (codes[rows] == 0))
                for who, first, last in refine.cover_ranges(v[pick], int(r)):
                    yield rows[pick][who], first, last

    return codes, blocks()


def _source(df: DataFrame, resolution, key: str, vertices: str) -> tuple[DataFrame, int | None]:
    kind = df.schema[vertices].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(kind.elementType) in (2, 3)):
        raise TypeError(f"{vertices} must be ARRAY<STRUCT<x,y,z>>, or ARRAY<STRUCT<lon,lat>> in degrees.")
    fields = "x:double,y:double,z:double" if len(kind.elementType) == 3 else "lon:double,lat:double"
    columns = [df[key], df[vertices].cast(f"array<struct<{fields}>>").alias(vertices)]
    if isinstance(resolution, str):
        if not isinstance(df.schema[resolution].dataType, T.IntegralType):
            raise TypeError("resolution must be an integer.")
        return df.select(*columns, df[resolution].alias("__resolution")), None
    return df.select(*columns), codec.check_resolution(as_resolution(resolution))


def _strict(mode: str) -> bool:
    if mode not in ("strict", "permissive"):
        raise ValueError("mode must be 'strict' or 'permissive'.")
    return mode == "strict"


def cover_ranges(
    df: DataFrame, resolution, key: str = "footprint_id", vertices: str = "vertices", mode: str = "strict"
) -> DataFrame:
    """(key, cell_first, cell_last): disjoint ranges of consecutive ids, none longer than LONGEST.

    ``resolution`` is an int for all rows or the name of a column.
    """
    source, fixed = _source(df, resolution, key, vertices)
    strict = _strict(mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for rows, first, last in _work(batch, fixed, strict)[1]:
                pieces = (last - first) // LONGEST + 1
                if (pieces > 1).any():
                    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    rows, first, last = (np.repeat(x, pieces) for x in (rows, first, last))
                    first = first + nth * LONGEST
                    last = np.minimum(last, first + LONGEST - 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), pa.array(first), pa.array(last)], [key, "cell_first", "cell_last"]
                )

    schema = T.StructType(
        [df.schema[key], T.StructField("cell_first", T.LongType()), T.StructField("cell_last", T.LongType())]
    )
    return source.mapInArrow(run, schema)


def expand_ranges(ranges: DataFrame, key: str) -> DataFrame:
    return ranges.select(key, F.explode(F.sequence("cell_first", "cell_last")).alias("cell_id"))


def cover_footprint(
    df: DataFrame,
    resolution,
    key: str = "footprint_id",
    vertices: str = "vertices",
    mode: str = "strict",
    spread: int | None = None,
) -> DataFrame:
    """(key, cell_id), one row for each cell whose center lies in the footprint.

    ``spread`` partitions: shuffles the ranges, which are few, before they are
    expanded, so that one very wide footprint does not keep one task busy.
    """
    ranges = cover_ranges(df, resolution, key, vertices, mode)
    if spread:
        ranges = ranges.repartition(spread, "cell_first")
    return expand_ranges(ranges, key)


def _per_row(df: DataFrame, resolution, key, vertices, mode, fields, build) -> DataFrame:
    source, fixed = _source(df, resolution, key, vertices)
    strict = _strict(mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, blocks = _work(batch, fixed, strict)
            yield from build(batch, codes, blocks)

    return source.mapInArrow(run, T.StructType([df.schema[key], *fields]))


def cover_counts(
    df: DataFrame, resolution, key: str = "footprint_id", vertices: str = "vertices", mode: str = "strict"
) -> DataFrame:
    """(key, n BIGINT), one row per good footprint, 0 included; nothing is expanded or shuffled."""

    def build(batch, codes, blocks):
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for rows, first, last in blocks:
            np.add.at(n, rows, last - first + 1)
        good = np.flatnonzero(codes == 0)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(n[good])], [key, "n"])

    return _per_row(df, resolution, key, vertices, mode, [T.StructField("n", T.LongType())], build)


def cover_arrays(
    df: DataFrame, resolution, key: str = "footprint_id", vertices: str = "vertices", mode: str = "strict"
) -> DataFrame:
    """(key, cell_ids ARRAY<BIGINT>), ids ascending, an empty array for no cell."""

    def build(batch, codes, blocks):
        found = list(blocks)
        good = np.flatnonzero(codes == 0)
        who, first, last = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((),) * 3))
        who, first, last = refine.merge_ranges(who, first, last)
        length = last - first + 1
        ends = np.cumsum(length)
        ids = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)
        per = np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(per, who, length)
        offsets = np.r_[0, np.cumsum(per[good])]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), lists], [key, "cell_ids"])

    return _per_row(df, resolution, key, vertices, mode, [T.StructField("cell_ids", T.ArrayType(T.LongType()))], build)


def validate_footprints(df: DataFrame, key: str = "footprint_id", vertices: str = "vertices") -> DataFrame:
    """(key, error STRING), one row per row; error is null for a good footprint."""

    def build(batch, codes, blocks):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_messages(codes), type=pa.string())], [key, "error"]
        )

    return _per_row(df, 0, key, vertices, "permissive", [T.StructField("error", T.StringType())], build)


def lonlat_vertices(column):
    """ARRAY<STRUCT<lon,lat>> of degrees to ARRAY<STRUCT<x,y,z>>; bad degrees give null vertices."""
    from ..functions.cells import lonlat_to_xyz

    return F.transform(column, lambda v: lonlat_to_xyz(v.getField("lon"), v.getField("lat")))


def cover_lonlat(
    df: DataFrame, resolution, key: str = "footprint_id", vertices: str = "vertices", mode: str = "strict", **more
) -> DataFrame:
    """cover_footprint of vertices given as ARRAY<STRUCT<lon,lat>> in degrees.

    Longitudes are unbounded.  Of the rules of a footprint, degrees that are not finite and latitudes
    beyond the poles come right after the number of vertices.
    """
    kind = df.schema[vertices].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(kind.elementType) == 2):
        raise TypeError(f"{vertices} must be ARRAY<STRUCT<lon,lat>>.")
    return cover_footprint(df, resolution, key, vertices, mode, **more)


def coverage_offsets(counts: DataFrame, key: str = "footprint_id", n: str = "n") -> DataFrame:
    """(key, offset_start, offset_stop) of each footprint's slice, in order of an integer key.

    Keys are sorted into ranges, one a partition; what lies before a range is the sum of the ranges before,
    of which there are as many as partitions.  No task holds more than its range.  A range has whole keys.
    """
    from pyspark.sql import Window

    ranged = counts.select(F.col(key), F.col(n).alias("n")).repartitionByRange(key)
    placed = cut(ranged.withColumn("__range", F.spark_partition_id()))
    sums = sorted((r[0], r[1] or 0) for r in placed.groupBy("__range").agg(F.sum("n")).collect())
    ends, total = [], 0
    for part, size in sums:
        ends.append((part, total))
        total += size
    before = F.broadcast(counts.sparkSession.createDataFrame(ends, "__range int, __before bigint"))
    within = F.sum("n").over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("__stop", within).join(before, "__range")
    stop = F.col("__before") + F.col("__stop")
    return summed.select(key, (stop - F.col("n")).alias("offset_start"), stop.alias("offset_stop"))
