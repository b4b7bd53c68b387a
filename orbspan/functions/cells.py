"""Column functions on packed cell ids.

The codec is made of built-in expressions, so filters and projections on ids stay
in generated code.  Centers and corners need about thirty operations on shared
terms each, which is cheaper in an Arrow batch than as one expression tree.

Null ids give null.  Ids that are not valid give null, or an error where
``strict`` is set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import codec, grid, polygon

LONLAT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
VEC = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _bits(c: Column) -> Column:
    """Number of bits of a positive id.

    The logarithm is off by less than the slack, which counts one bit too many just below a power of two;
    ids there have four ones after the marker or a marker at an odd place, so they are not valid either way.
    """
    return (F.floor(F.log2(c.cast("double")) + 1e-9) + 1).cast("int")


def is_cell_id(c) -> Column:
    """True for valid packed ids; false for null."""
    c = _col(c)
    bits = _bits(c)
    # an even number of bits below the marker, and a face below 12 in the four bits after it
    face = F.call_function("shiftright", c, bits - 5)
    return F.coalesce((c >= 16) & (bits % 2 == 1) & (face >= 16) & (face < 28), F.lit(False))


def _raw_resolution(c: Column) -> Column:
    """Resolution from the position of the highest bit; right for valid ids only."""
    return F.call_function("shiftright", _bits(c) - 5, F.lit(1))


def cell_resolution(c, strict: bool = False) -> Column:
    c = _col(c)
    bad = F.raise_error(codec.BAD_ID).cast("int") if strict else F.lit(None).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("int")).when(is_cell_id(c), _raw_resolution(c)).otherwise(bad)


def nested_index(c, strict: bool = False) -> Column:
    c = _col(c)
    r = cell_resolution(c, strict)
    return c.bitwiseXOR(F.call_function("shiftleft", _big(1), r * 2 + 4))


def decode_cell_id(c, strict: bool = False) -> Column:
    """struct(resolution, nested)."""
    r = cell_resolution(c, strict)
    return F.when(r.isNotNull(), F.struct(r.alias("resolution"), nested_index(c).alias("nested")))


def encode_cell_id(resolution, nested, strict: bool = False) -> Column:
    r, nested = (F.lit(resolution) if isinstance(resolution, int) else _col(resolution)), _col(nested)
    fits = r.between(0, codec.MAX_RESOLUTION) & (nested >= 0) & (nested < pixel_count(r))
    packed = F.call_function("shiftleft", _big(1), r * 2 + 4).bitwiseOR(nested)
    if not strict:
        return F.when(fits, packed)
    why = F.when(r.between(0, codec.MAX_RESOLUTION), F.lit(codec.BAD_NESTED)).otherwise(F.lit(codec.BAD_RESOLUTION))
    return F.when(r.isNull() | nested.isNull(), F.lit(None).cast("bigint")).when(fits, packed).otherwise(
        F.raise_error(why).cast("bigint")
    )


def _level(resolution) -> Column:
    return F.lit(resolution) if isinstance(resolution, int) else _col(resolution)


def nside(resolution) -> Column:
    """Cells along the side of a base face: 2**resolution; null for what is no resolution."""
    r = _level(resolution)
    return F.when(r.between(0, codec.MAX_RESOLUTION), F.call_function("shiftleft", _big(1), r))


def pixel_count(resolution) -> Column:
    """Cells of a resolution: 12 * 4**resolution; null for what is no resolution."""
    r = _level(resolution)
    return F.when(r.between(0, codec.MAX_RESOLUTION), F.call_function("shiftleft", _big(12), r * 2))


def parent_cell(c, resolution) -> Column:
    """The cell of a coarser resolution around a cell; null where it is finer."""
    c = _col(c)
    target = F.lit(resolution) if isinstance(resolution, int) else _col(resolution)
    up = cell_resolution(c) - target
    return F.when((up >= 0) & (target >= 0), F.call_function("shiftright", c, up * 2))


def children_range(c, resolution) -> Column:
    """struct(first, last) of the ids of a finer resolution inside a cell."""
    c = _col(c)
    target = F.lit(resolution) if isinstance(resolution, int) else _col(resolution)
    down = target - cell_resolution(c)
    first = F.call_function("shiftleft", c, down * 2)
    last = first + F.call_function("shiftleft", _big(1), down * 2) - 1
    return F.when((down >= 0) & (target <= codec.MAX_RESOLUTION), F.struct(first.alias("first"), last.alias("last")))


def _checked(ids: pd.Series, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    known = ids.notna().to_numpy()
    values = ids.fillna(0).astype("int64").to_numpy()
    good = known & codec.is_valid(values)
    if strict and (known & ~good).any():
        raise ValueError(codec.BAD_ID)
    return values, good


def _centers(strict: bool):
    @F.pandas_udf(LONLAT)
    def run(ids: pd.Series) -> pd.DataFrame:
        values, good = _checked(ids, strict)
        out = np.full((len(ids), 2), np.nan)
        if good.any():
            out[good] = grid.centers_lonlat(values[good])
        return pd.DataFrame(out, columns=["lon", "lat"]).astype("Float64").mask(np.isnan(out))

    return run


def _boundaries(strict: bool):
    @F.arrow_udf(T.ArrayType(LONLAT))
    def run(ids: pa.Array) -> pa.Array:
        values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        good = known & codec.is_valid(values)
        if strict and (known & ~good).any():
            raise ValueError(codec.BAD_ID)
        corners = grid.corners_lonlat(values[good]).reshape(-1, 2) if good.any() else np.empty((0, 2))
        pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(corners[:, k])) for k in (0, 1)], ["lon", "lat"])
        # an id that is not valid has no corners: its offset is null
        ends = np.r_[0, np.cumsum(np.where(good, 4, 0))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[~good, False]), pairs)

    return run


def centers(c, strict: bool = False) -> Column:
    """struct(lon, lat) in degrees; both null for ids that are null or not valid."""
    return _centers(strict)(_col(c))


def boundaries(c, strict: bool = False) -> Column:
    """Four struct(lon, lat): north, west, south, east; not closed."""
    return _boundaries(strict)(_col(c))


def lonlat_to_xyz(lon, lat, strict: bool = False) -> Column:
    """Unit vector of degrees; longitude is unbounded.

    A degree that is not finite or a latitude beyond the poles gives null, or stops the query if ``strict``; nulls give null.
    """
    lon, lat = _col(lon).cast("double"), _col(lat).cast("double")
    finite = (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    x, y = F.radians(lon), F.radians(lat)
    vector = F.struct((F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z"))
    if not strict:
        return F.when(finite & (F.abs(lat) <= 90.0), vector)
    stop = lambda k: F.raise_error(polygon.MESSAGES[k]).cast("struct<x:double,y:double,z:double>")
    return F.when(~finite, stop(polygon.NOT_FINITE)).when(F.abs(lat) > 90.0, stop(polygon.BEYOND_POLES)).when(finite, vector)


def xyz_to_lonlat(v) -> Column:
    """struct(lon, lat) in degrees of a vector of any length; -180 is given as 180."""
    v = _col(v)
    x, y, z = (v.getField(c) for c in "xyz")
    lon = F.degrees(F.atan2(y, x))
    return F.struct(F.when(lon <= -180.0, 180.0).otherwise(lon).alias("lon"), F.degrees(F.atan2(z, F.hypot(x, y))).alias("lat"))
