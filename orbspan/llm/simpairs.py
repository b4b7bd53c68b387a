"""All pairs of similar sets.

Exact copies are collapsed to one class first.  Items that one class alone has meet
nothing; a class keeps the others, and only if they are enough for a pair above the
threshold.  Such a class has a packed code of SKETCH one-bit minhashes of what it
keeps, and is listed under the rarest of these items, one of which any partner has
(its prefix); so common items make no pairs.  What meets must have sizes that fit
and codes within a Hamming radius that is calibrated to the threshold: with SIGMAS
standard deviations a true pair is lost with a probability below 1e-10.  What passes
is verified on the sets.

Instead of the prefixes the segments of the codes may be joined (``method="segments"``):
two classes meet where one of the SEGMENTS segments differs in at most one bit, so
one of its halves is equal.  Bits of sets with similarity s agree with probability
(1 + s) / 2, so this finds the share of pairs that recall() tells, all but one in a
hundred at 0.5 on the test tables (p4_recall).  The prefixes lose nothing and
are the default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .overlaps import sent_if_small

SKETCH = 256
SIGMAS = 6.5
#: Sets that meet under one item, or copies of one set, in one place.
SPLIT = 1024
_WORDS = SKETCH // 64
_CODE = [f"c{w}" for w in range(_WORDS)]
_BLOCK = 1 << 18


def radius(threshold: float) -> int:
    """Hamming distance that pairs at the threshold stay within, but for 1e-10 of them."""
    p = (1.0 - threshold) / 2.0
    return min(SKETCH, math.ceil(SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p))))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 63, size=(2, SKETCH), dtype=np.uint64)
    return a | np.uint64(1), b


def codes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, SKETCH / 64) uint64: the low bit of each of SKETCH minhashes; sizes are above 0."""
    out = np.zeros((len(sizes), _WORDS), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    a, b = _multipliers()
    for k in range(SKETCH):
        least = np.minimum.reduceat((hashes * a[k] + b[k]) >> np.uint64(20), starts)
        out[:, k // 64] |= (least & np.uint64(1)) << np.uint64(k % 64)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sketches(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(key, c0, c1, ...): packed codes of sets given as ARRAY<BIGINT>; empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            with np.errstate(over="ignore"):
                hashes = _mix(lists.flatten().to_numpy(zero_copy_only=False))
                found = codes(hashes, sizes) if len(sizes) else np.empty((0, _WORDS), np.uint64)
            columns = [pa.array(np.ascontiguousarray(found[:, w]).view(np.int64)) for w in range(_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *(f"c{w}" for w in range(_WORDS))])

    schema = f"{key} bigint, " + ", ".join(f"c{w} bigint" for w in range(_WORDS))
    return sets.where(F.size(items) > 0).select(key, items).mapInArrow(run, schema)


def hamming(left: str, right: str) -> Column:
    total = F.lit(0)
    for w in range(_WORDS):
        total = total + F.bit_count(F.col(f"{left}.c{w}").bitwiseXOR(F.col(f"{right}.c{w}")))
    return total


def fingered(sets: DataFrame) -> DataFrame:
    """Sets (id, items) with columns that tell different sets apart: size and 128 bits of hash."""
    return sets.select("id", "items", F.size("items").alias("n"), F.xxhash64("items").alias("f1"), F.xxhash64(F.lit(7), "items").alias("f2"))


def classes(sets: DataFrame) -> DataFrame:
    """(id, class) of fingered sets: class is the smallest id with the same set."""
    finger = sets.select("id", "n", "f1", "f2")
    least = finger.groupBy("n", "f1", "f2").agg(F.min("id").alias("class"))
    return finger.join(least, ["n", "f1", "f2"]).select("id", "class")


def recall(similarity: float, segments: int = SKETCH // 16, bits: int = 16) -> float:
    """Share of pairs of this similarity of which some segment differs in at most one bit."""
    p = (1.0 + similarity) / 2.0
    return 1.0 - (1.0 - p**bits - bits * p ** (bits - 1) * (1.0 - p)) ** segments


def _parts(df: DataFrame, last: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of a table with itself, where a key's rows meet in parts: one side goes to all parts, the other is spread over them."""
    a = df.withColumn("part", F.explode(F.sequence(F.lit(0), last))).alias("a")
    return a, df.withColumn("part", F.pmod(F.xxhash64("id"), F.col(last) + 1).cast("int")).alias("b")


def _by_prefix(able: DataFrame, coded: DataFrame) -> DataFrame:
    """(id, n, codes, key, last): a row for each item of the prefix."""
    rows = able.select("id", F.explode("prefix").alias("p")).join(coded, "id")
    return rows.select("id", "n", F.col("p.item").alias("key"), ((F.col("p.held") - 1) / SPLIT).cast("int").alias("last"), *_CODE)


def _by_segment(coded: DataFrame) -> DataFrame:
    """(id, n, codes, key, last): a row for each half of a segment; there are 256 values for each half, so their numbers are a small table."""
    halves = [F.call_function("shiftrightunsigned", f"c{w}", F.lit(8 * h)).bitwiseAND(F.lit(255)) for w in range(_WORDS) for h in range(8)]
    rows = coded.select("id", "n", *_CODE, F.posexplode(F.array(*halves)).alias("slot", "value"))
    rows = rows.select("id", "n", *_CODE, "slot", (F.col("slot") * 256 + F.col("value")).alias("key"))
    many = rows.groupBy("key").agg(((F.count("*") - 1) / SPLIT).cast("int").alias("last"))
    return rows.join(F.broadcast(many), "key")


def _segment_differs() -> Column:
    """Bits in which the segment of a half differs between both sides."""
    word = lambda side: F.element_at(F.array(*[F.col(f"{side}.c{w}") for w in range(_WORDS)]), (F.floor(F.col("a.slot") / 8) + 1).cast("int"))
    at = (F.floor((F.col("a.slot") % 8) / 2) * 16).cast("int")
    return F.bit_count(F.call_function("shiftrightunsigned", word("a").bitwiseXOR(word("b")), at).bitwiseAND(F.lit(0xFFFF)))


def similar_classes(sets: DataFrame, threshold: float, method: str = "prefix") -> DataFrame:
    """(a, b, common, size_a, size_b) of sets (id, items) that are all different, a < b."""
    near, least = radius(threshold), F.ceil(F.col("n") * (threshold - 1e-9))
    member = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    held = cut(member.groupBy("item").agg(F.count("*").alias("held")).where("held > 1"))
    kept = member.join(sent_if_small(held), "item").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).alias("kept"))
    able = cut(kept.where(F.size("kept") >= least).select("id", "n", F.col("kept.item").alias("items"), F.slice("kept", 1, (F.size("kept") - least + 1).cast("int")).alias("prefix")))
    coded = able.select("id", "n").join(sketches(able, "id", "items"), "id")
    a, b = _parts(cut(_by_segment(coded) if method == "segments" else _by_prefix(able, coded)), "last")
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (threshold - 1e-9)) & (hamming("a", "b") <= near)
    if method == "segments":
        fits = fits & (_segment_differs() <= 1)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & fits)
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("size_a"), F.col("b.n").alias("size_b")).distinct()
    # what two sets have in common is among the items they keep
    left, right = able.select(F.col("id").alias("a"), F.col("items").alias("x")), able.select(F.col("id").alias("b"), F.col("items").alias("y"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), "size_a", "size_b")
    return checked.where(F.col("common") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9)


def similar_sets(named: DataFrame, threshold: float, method: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """((a, b, common, size_a, size_b), (id, class)): links between representatives of equal sets, and who each stands for.

    ``named`` is (id, items), clean: different ids, sorted different items, no empty sets.  A
    representative is the smallest id of its set, so copies take no more than a row each.
    """
    named = cut(fingered(named))
    owner = cut(classes(named))
    copies = sent_if_small(owner.where("id <> class").select("id"))
    reps = named.join(copies, "id", "left_anti")
    return similar_classes(reps.select("id", "items"), threshold, method), owner


def similar_pairs(
    sets: DataFrame, threshold: float, key: str = "id", items: str = "items", other: DataFrame | None = None, method: str = "prefix"
) -> DataFrame:
    """(id_a, id_b): pairs of keys whose sets have a Jaccard similarity of at least ``threshold``.

    ``sets`` is (key BIGINT, items ARRAY<BIGINT>), one row per key; values repeated
    in a list count once, nulls not at all; null keys and empty sets are in no pair.
    Within one table id_a < id_b.  With ``other`` the pairs are between the tables,
    id_a from ``sets`` and id_b from ``other``.  ``method`` is prefix (all pairs) or
    segments (the share of them that recall() tells).
    """
    if method not in ("prefix", "segments"):
        raise ValueError("method must be 'prefix' or 'segments'.")
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be above 0 and at most 1.")

    def clean(df: DataFrame) -> DataFrame:
        s = df.select(F.col(key).cast("bigint").alias("id"), F.sort_array(F.array_distinct(F.array_compact(F.col(items).cast("array<bigint>")))).alias("items"))
        return s.where(F.col("id").isNotNull() & (F.size("items") > 0))

    if other is None:
        rows = clean(sets)
        named = rows
    else:
        # keys of both tables go into one space: even ids on the left, odd on the right
        named = clean(sets).withColumn("id", F.col("id") * 2).union(clean(other).withColumn("id", F.col("id") * 2 + 1))
    links, owner = similar_sets(named, threshold, method)
    x, y = owner.select(F.col("id").alias("id1"), F.col("class").alias("a")), owner.select(F.col("id").alias("id2"), F.col("class").alias("b"))
    apart = links.select("a", "b").join(x, "a").join(y, "b").select("id1", "id2")
    # all pairs of copies are asked for: the copies of one set are split over tasks by their number
    many = owner.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    copies = owner.join(many, "class").withColumn("last", ((F.col("n") - 1) / SPLIT).cast("int"))
    c = copies.select("class", F.col("id").alias("id1"), F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    d = copies.select("class", F.col("id").alias("id2"), F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int").alias("part"))
    same = c.join(d, ["class", "part"]).where("id1 < id2").select("id1", "id2")
    out = apart.union(same)
    low, high = F.least("id1", "id2"), F.greatest("id1", "id2")
    if other is None:
        return out.select(low.alias("id_a"), high.alias("id_b"))
    out = out.where("(id1 % 2 = 0) != (id2 % 2 = 0)")
    even = F.when(F.col("id1") % 2 == 0, F.col("id1")).otherwise(F.col("id2"))
    odd = F.when(F.col("id1") % 2 == 0, F.col("id2")).otherwise(F.col("id1"))
    return out.select((even / 2).cast("bigint").alias("id_a"), ((odd - 1) / 2).cast("bigint").alias("id_b"))
