"""Distinct counts from multiresolution bitmaps.

A 64-bit hash puts an identifier in level j with probability 2**-(j+1) (its
trailing zeros) and at one of ``BITS`` positions of that level (its top bits).  A
sketch is the set of nonempty 64-bit words, as rows ``(keys..., slot, word, n)``:
building is a grouped ``bit_or`` in generated code with map-side combine, merging
is the same ``bit_or`` again, over days, files or coarser keys.  A group holds at
most LEVELS * BITS / 64 words however many identifiers it has.

Estimate: with base = one above the highest level that is filled beyond FULL,
n = 2**base * sum over levels >= base of BITS * ln(BITS / zeros).  The levels from
base on hold 1 to 2 times BITS hashes at base when the group is large, so the
relative error does not depend on its size: its standard deviation is at most
ERROR = 1.1 / sqrt(BITS), 1.7 %.

Nulls in the identifier are not counted.  A null key is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4096
LEVELS = 40
FULL = 0.865  # load of about two hashes a position
ERROR = 1.1 / BITS**0.5
_WORDS = BITS // 64


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def sketch(df: DataFrame, keys: list[str], identifier: str) -> DataFrame:
    """(keys..., slot, word, n): partial results; n is the number of rows behind a word."""
    h = F.xxhash64(identifier)
    lowest = h.bitwiseAND(-h)
    level = F.least(F.bit_count(lowest - 1), F.lit(LEVELS - 1))
    place = F.shiftrightunsigned(h, 64 - (BITS.bit_length() - 1)).cast("int")
    rows = df.where(F.col(identifier).isNotNull()).select(
        *keys,
        (level * _WORDS + F.shiftright(place, 6)).alias("slot"),
        F.call_function("shiftleft", _long(1), place.bitwiseAND(F.lit(63))).alias("bit"),
    )
    return rows.groupBy(*keys, "slot").agg(F.bit_or("bit").alias("word"), F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Union of sketches with the same (possibly fewer) keys."""
    return sketches.groupBy(*keys, "slot").agg(F.bit_or("word").alias("word"), F.sum("n").alias("n"))


def merge_sets(sketches: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """merge() for several groupings at once; a key that is not grouped by is null and ``__set`` tells the grouping."""
    columns = [F.col(k) for k in [*keys, "slot"]]
    out = sketches.groupingSets([[F.col(k) for k in [*s, "slot"]] for s in sets], *columns)
    out = out.agg(F.bit_or("word").alias("word"), F.sum("n").alias("n"), F.grouping_id(*columns).alias("__set"))
    return out


def estimate(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, estimate DOUBLE)."""
    levels = sketches.groupBy(*keys, F.floor(F.col("slot") / _WORDS).cast("int").alias("level")).agg(
        F.sum(F.bit_count("word")).alias("ones"), F.sum("n").alias("n")
    )
    groups = levels.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("level", "ones"))).alias("l"),
        F.sum("n").alias("n"),
        F.max(F.when(F.col("ones") > FULL * BITS, F.col("level") + 1).otherwise(0)).alias("base"),
    )
    linear = F.aggregate(
        "l",
        F.lit(0.0),
        lambda a, x: a + F.when(x["level"] >= F.col("base"), -BITS * F.ln(1.0 - F.least(x["ones"], F.lit(BITS - 1)) / BITS)).otherwise(0.0),
    )
    return groups.select(*keys, "n", (F.pow(F.lit(2.0), F.col("base")) * linear).alias("estimate"))
