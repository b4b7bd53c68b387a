"""Cover of footprints as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cover import cover_footprint


def cover_stream(footprints: DataFrame, resolution, key: str = "footprint_id", vertices: str = "vertices") -> DataFrame:
    """(key, cell_id) of a streaming DataFrame.  Stateless, so any output mode and any
    restart gives what a batch over the same rows gives; bad footprints are left out."""
    return cover_footprint(footprints, resolution, key, vertices, mode="permissive")


def late_counts(coverage: DataFrame, time: str, window: str, lateness: str, cell: str = "cell_id") -> DataFrame:
    """(window, cell, n): rows per cell and event-time window, closed ``lateness`` after the newest row."""
    return coverage.withWatermark(time, lateness).groupBy(F.window(time, window), cell).agg(F.count("*").alias("n"))
