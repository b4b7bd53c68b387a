"""Footprints and coverage from array files and from the offset form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Coverage


def load_footprints(path) -> np.ndarray:
    """(footprints, vertices, 3) of an .npy file, or of ``footprints`` in an .npz file."""
    data = np.load(path)
    if isinstance(data, np.lib.npyio.NpzFile):
        if "footprints" not in data:
            raise ValueError("NPZ footprint files must contain a 'footprints' array.")
        data = data["footprints"]
    data = np.ascontiguousarray(data, dtype=np.float64)
    if data.ndim != 3 or data.shape[2] != 3:
        raise ValueError("Dense footprint files must have shape (footprints, vertices, 3).")
    return data


def footprints_from_arrays(spark: SparkSession, footprints: np.ndarray) -> DataFrame:
    """(footprint_id, vertices) of a dense batch; ids are positions from 0."""
    many, n, _ = footprints.shape
    flat = footprints.reshape(-1, 3)
    vec = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["x", "y", "z"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * n), vec)
    return spark.createDataFrame(pa.table({"footprint_id": np.arange(many), "vertices": lists}))


def coverage_from_arrays(spark: SparkSession, coverage: Coverage) -> DataFrame:
    """(footprint_id, cell_id) of a Coverage; empty slices give no row."""
    owner = np.repeat(np.arange(len(coverage.counts)), coverage.counts)
    return spark.createDataFrame(pa.table({"footprint_id": owner, "cell_id": coverage.cell_ids.astype(np.int64)}))


def well_formed(offsets: str = "offsets", keys: str = "footprint_ids", cells: str = "cell_ids") -> Column:
    """Whether offsets cut the cells: one more than the keys, from 0, never falling, to the end."""
    o = F.col(offsets)
    rising = F.forall(F.sequence(F.lit(1), F.size(o) - 1), lambda k: F.get(o, k) >= F.get(o, k - 1))
    return F.coalesce(
        (F.size(o) == F.size(keys) + 1) & (F.get(o, 0) == 0) & (F.element_at(o, -1) == F.size(cells)) & ((F.size(o) < 2) | rising),
        F.lit(False),
    )


def well_formed_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, footprint_ids, offsets, cell_ids) of the well-formed batches, each batch_id once.

    Copies of a batch are dropped with map-side combine; null batch ids are left out.
    """
    once = batches.where(well_formed() & F.col("batch_id").isNotNull()).select("batch_id", "footprint_ids", "offsets", "cell_ids")
    return once.dropDuplicates(["batch_id"])


def batch_slices(batches: DataFrame) -> DataFrame:
    """(batch_id, footprint_id, cells): one row for each slice of the well-formed batches."""
    once = well_formed_batches(batches)
    k = F.col("__k")
    cut = F.slice("cell_ids", F.get("offsets", k).cast("int") + 1, (F.get("offsets", k + 1) - F.get("offsets", k)).cast("int"))
    return once.select("batch_id", F.posexplode("footprint_ids").alias("__k", "footprint_id"), "offsets", "cell_ids").select(
        "batch_id", "footprint_id", cut.alias("cells")
    )


def explode_batches(batches: DataFrame) -> DataFrame:
    """Long form (batch_id, footprint_id, cell_id) of the offset form."""
    return batch_slices(batches).select("batch_id", "footprint_id", F.explode("cells").alias("cell_id"))
