"""The operators by name in SQL text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .functions import cells
from .kernels import codec, polygon, refine
from .operators.cover import LONGEST


@udtf(returnType="cell_first: bigint, cell_last: bigint")
class CoverRanges:
    """Ranges of consecutive ids of a footprint, few even for a wide one; a footprint that breaks a rule stops the query."""

    def eval(self, vertices, resolution):
        codec.check_resolution(resolution)
        null = vertices is None or any(v is None or None in tuple(v) for v in vertices)
        flat = np.array([tuple(v) for v in vertices], dtype=np.float64).reshape(-1, 3) if not null else np.empty((0, 3))
        codes, rings = polygon.normalize(flat, np.array([0, len(flat)]), np.array([null]))
        if codes[0]:
            raise ValueError(polygon.MESSAGES[codes[0]])
        parts = [x for _, ring in rings for x in refine.cover_ranges(ring, resolution)]
        if parts:
            _, first, last = refine.merge_ranges(*(np.concatenate(x) for x in zip(*parts)))
            for a, b in zip(first.tolist(), last.tolist()):
                for at in range(a, b + 1, LONGEST):
                    yield at, min(b, at + LONGEST - 1)


def register(spark: SparkSession) -> None:
    """``cell_center(id)``, ``cell_boundary(id)`` and the table functions ``cover_ranges(vertices, r)``, ``cover_cells(vertices, r)``.

    ``SELECT f.footprint_id, c.cell_id FROM footprints f, LATERAL cover_cells(f.vertices, 4) c``:
    Python gives ranges, which are expanded in generated code.  For large tables prefer the
    DataFrame operator, which takes whole Arrow batches.
    """
    spark.udf.register("cell_center", cells._centers(False))
    spark.udf.register("cell_boundary", cells._boundaries(False))
    spark.udtf.register("cover_ranges", CoverRanges.asDeterministic())
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION cover_cells(vertices ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>>, resolution INT)
        RETURNS TABLE (cell_id BIGINT)
        RETURN SELECT e.cell_id FROM cover_ranges(cover_cells.vertices, cover_cells.resolution) c, LATERAL explode(sequence(c.cell_first, c.cell_last)) e(cell_id)"""
    )
