"""Cover of the quadrilaterals between consecutive samples of a swath."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cover import cover_footprint


def swath_footprints(
    samples: DataFrame,
    swath: str = "swath_id",
    seq: str = "seq",
    left: str = "left_edge_xyz",
    right: str = "right_edge_xyz",
    block: int = 4096,
    mode: str = "strict",
) -> DataFrame:
    """(swath, seq, vertices): for each sample but a swath's last, [l_i, r_i, r_i+1, l_i+1].

    ``seq`` orders the samples; numbers may be missing, the interval then spans the
    gap.  Rows repeated under one (swath, seq) count once.  Rows with a null swath
    or seq have no place in the order and are left out.  A swath of one sample has
    no interval: ``strict`` raises, ``permissive`` leaves it out.

    A long swath is cut into blocks of ``block`` sequence numbers.  The window runs
    within blocks, and the last sample of a block gets its successor from a table of
    the blocks' first samples, so no task holds a whole swath.
    """
    s = samples.select(
        F.col(swath).alias("__swath"), F.col(seq).alias("__seq"), F.struct(F.col(left).alias("l"), F.col(right).alias("r")).alias("__e")
    ).where("__swath is not null and __seq is not null")
    s = s.withColumn("__block", F.floor(F.col("__seq") / block)).dropDuplicates(["__swath", "__block", "__seq"])
    inner = Window.partitionBy("__swath", "__block").orderBy("__seq")
    s = s.withColumn("__next", F.lead("__e").over(inner)).withColumn("__end", F.lead("__seq").over(inner).isNull())
    first = s.groupBy("__swath", "__block").agg(F.min_by("__e", "__seq").alias("__first"), F.count("*").alias("__n"))
    order = Window.partitionBy("__swath").orderBy("__block")
    first = first.select(
        "__swath",
        "__block",
        F.lead("__first").over(order).alias("__after"),
        (F.sum("__n").over(Window.partitionBy("__swath")) < 2).alias("__short"),
    )
    s = s.join(first, ["__swath", "__block"])
    if mode == "strict":
        s = s.withColumn(
            "__end",
            F.when(F.col("__short"), F.raise_error("cover_swath() requires at least two edge samples.").cast("boolean")).otherwise(
                F.col("__end")
            ),
        )
    follow = F.when(F.col("__end"), F.col("__after")).otherwise(F.col("__next"))
    quad = F.array(F.col("__e.l"), F.col("__e.r"), F.col("__f.r"), F.col("__f.l"))
    return (
        s.withColumn("__f", follow)
        .where("__f is not null")
        .select(F.col("__swath").alias(swath), F.col("__seq").alias(seq), quad.alias("vertices"))
    )


def cover_swath(
    samples: DataFrame,
    resolution,
    swath: str = "swath_id",
    seq: str = "seq",
    left: str = "left_edge_xyz",
    right: str = "right_edge_xyz",
    mode: str = "strict",
    spread: int | None = None,
) -> DataFrame:
    """(swath, seq, cell_id); seq is that of the interval's first sample."""
    quads = swath_footprints(samples, swath, seq, left, right, mode=mode)
    keyed = quads.select(F.struct(swath, seq).alias("__key"), "vertices")
    return cover_footprint(keyed, resolution, "__key", "vertices", mode, spread).select(
        F.col(f"__key.{swath}").alias(swath), F.col(f"__key.{seq}").alias(seq), "cell_id"
    )
