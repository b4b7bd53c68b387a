"""Groups with few different values among many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from ..lineage import cut

#: Standard deviations on either side of the limit in which a group is counted exactly.
BAND = 5.0
#: Groups up to which the list of groups to recount is sent to all executors.
MOST_BROADCAST = 20_000


def group_estimates(df: DataFrame, keys: list[str], identifier: str, sets: list[list[str]]) -> DataFrame:
    """(__set, keys..., n, estimate) for every grouping in ``sets``, all from one pass over the rows.

    The finest bitmaps are built once; coarser groupings are their unions.
    """
    merged = bitmaps.merge_sets(bitmaps.sketch(df, keys, identifier), sets, keys)
    return bitmaps.estimate(merged, ["__set", *keys])


def sparse_groups(df: DataFrame, keys: list[str], identifier: str, sets: list[list[str]], least: int, share: float) -> DataFrame:
    """(keys...) of groups of at least ``least`` rows with fewer than ``share`` * rows different identifiers.

    The estimate decides all groups but those within BAND standard deviations of
    the limit; only the rows of these few are counted exactly.  Rows with a null
    key or identifier belong to no group.  In the result a key that is not grouped
    by is null.
    """
    rows = df.select(*keys, identifier).dropna()
    found = cut(group_estimates(rows, keys, identifier, sets).where(F.col("n") >= least))
    limit = F.col("n") * share
    slack = F.greatest(F.col("estimate"), limit) * (BAND * bitmaps.ERROR) + 2
    sure = found.where(F.col("estimate") + slack < limit).select(*keys)
    open_ = found.where(F.abs(F.col("estimate") - limit) <= slack)
    # a row belongs to one group of each grouping; all keys of the group are joined on
    kinds = {k: rows.schema[k].dataType for k in keys}
    groups = [F.struct(*[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for s in sets]
    own = rows.select(F.col(identifier).alias("__id"), F.explode(F.array(*groups)).alias("__g"))
    asked = open_.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n").alias("__n"))
    match = None
    for k in keys:
        one = F.col(f"__g.{k}").eqNullSafe(F.col(f"__{k}"))
        match = one if match is None else match & one
    small = open_.count() <= MOST_BROADCAST
    counted = (
        own.join(F.broadcast(asked) if small else asked, match)
        .groupBy(*[f"__{k}" for k in keys], "__n", "__id")
        .agg(F.lit(1).alias("__one"))
        .groupBy(*[f"__{k}" for k in keys], "__n")
        .agg(F.count("*").alias("__d"))
    )
    exact = counted.where(F.col("__d") * (1.0 / share) < F.col("__n")).select(*[F.col(f"__{k}").alias(k) for k in keys])
    return sure.union(exact)
