"""How often every term occurs, and in how many records.

Heavy terms are found with a space-saving summary; at most 4 * HEAVY of them are sent
to all tasks.  One pass over the rows then splits them:

- Rows of a heavy term never leave their task.  Its occurrences go to a local array
  of exact counters, one for each heavy term, which is sent once at the task's end.
  Its records go to local words of 64 record numbers, merged by OR; so what is
  shuffled are words, not rows, and records are still counted exactly.
- Rows of light terms, none of which has more than 1 / HEAVY of the rows, are counted
  by (term, record) where they are read and go through one shuffle by term.

The union of both tables has every term.  The different records of all rows come out
of the same pass, as if all rows had one more heavy term.

A null term is no term; a row with a null record counts as an occurrence and in no
record.  Repeated rows count as they stand.  Records that are no integers have no
words; their different (heavy term, record) pairs are shuffled one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .frequent import frequent_items

#: Shares of the rows from which a term is heavy; bounds the broadcast to four times as many terms.
HEAVY = 256
#: Rows that are counted together in a task, and places that a heavy term's words are spread to.
CHUNK = 1 << 17
SPREAD = 256
LIGHT, HEAVY_TERM, ALL = 0, 1, 2
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _words(owner: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, block, word): the different records of each owner, 64 numbers a word."""
    block, bit = record >> 6, np.uint64(1) << (record & 63).astype(np.uint64)
    order = np.lexsort((block, owner))
    owner, block, bit = owner[order], block[order], bit[order]
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]) if len(owner) else np.empty(0, np.int64)
    word = np.bitwise_or.reduceat(bit, start) if len(start) else bit
    return owner[start], block[start], word.view(np.int64)


def _split(heavy: pa.Array, integers: bool, kinds: tuple[pa.DataType, pa.DataType]):
    """One pass over rows (term, record): (kind, term, record, block, word, n)."""
    names = ["kind", "term", "record", "block", "word", "n"]

    def batch(kind: int, term, record, block, word, n) -> pa.RecordBatch:
        many = len(term)
        columns = [pa.array(np.full(many, kind, np.int32)), term, pa.nulls(many, kinds[1]) if record is None else record]
        columns += [pa.nulls(many, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (block, word, n)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(len(heavy), dtype=np.int64)
        waiting, size = [], 0

        def counted():
            table = pa.Table.from_batches(waiting)
            term, record = (table.column(k).combine_chunks() for k in (0, 1))
            which = pc.index_in(term, value_set=heavy)
            mine = pc.is_valid(which)
            at = pc.drop_null(which).to_numpy()
            np.add(counters, np.bincount(at, minlength=len(heavy)), out=counters)
            known = pc.is_valid(record)
            if integers:
                both = pc.and_(mine, known)
                owner, block, word = _words(which.filter(both).to_numpy(zero_copy_only=False), record.filter(both).cast(pa.int64()).to_numpy(zero_copy_only=False))
                yield batch(HEAVY_TERM, heavy.take(pa.array(owner)), None, block, word, None)
                every = record.filter(known).cast(pa.int64()).to_numpy(zero_copy_only=False)
                owner, block, word = _words(np.zeros(len(every), np.int32), every)
                yield batch(ALL, pa.nulls(len(owner), kinds[0]), None, block, word, None)
            else:
                pairs = pa.table([term, record], ["t", "r"])
                once = pairs.filter(pc.and_(mine, known)).group_by(["t", "r"], use_threads=False).aggregate([]).combine_chunks()
                yield batch(HEAVY_TERM, once.column("t").combine_chunks(), once.column("r").combine_chunks(), None, None, None)
                once = pairs.filter(known).group_by("r", use_threads=False).aggregate([]).combine_chunks()
                yield batch(ALL, pa.nulls(len(once), kinds[0]), once.column("r").combine_chunks(), None, None, None)
            light = pa.table([term, record], ["t", "r"]).filter(pc.invert(mine)).group_by(["t", "r"], use_threads=False)
            light = light.aggregate([([], "count_all")]).combine_chunks()
            yield batch(LIGHT, light.column("t").combine_chunks(), light.column("r").combine_chunks(), None, None, light.column("count_all").to_numpy())

        for one in batches:
            waiting.append(one)
            size += one.num_rows
            if size >= CHUNK:
                yield from counted()
                waiting, size = [], 0
        if size:
            yield from counted()
        if counters.any():
            yield batch(HEAVY_TERM, heavy, None, None, None, counters)

    return run


def count_table(df: DataFrame, term: str, record: str) -> tuple[DataFrame, DataFrame]:
    """((term, n, records), one row per different term; (records), one row: the different records of rows with a term)."""
    rows = df.select(F.col(term).alias("term"), F.col(record).alias("record")).where("term is not null")
    found = frequent_items(rows, "term", 1.0 / HEAVY, slack=4, exact=False).select(F.col("item").alias("term"))
    kind, other = rows.schema["term"].dataType, rows.schema["record"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(kind), to_arrow_type(other)
    heavy = pa.array([r[0] for r in found.collect()], kinds[0])
    integers = isinstance(other, _INTEGERS)
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("term", kind), T.StructField("record", other)]
        + [T.StructField(k, T.LongType()) for k in ("block", "word", "n")]
    )
    split = rows.mapInArrow(_split(heavy, integers, kinds), schema)
    # light terms by term alone; the words of a heavy one are spread
    place = F.when(F.col("kind") == LIGHT, F.lit(0)).otherwise(F.pmod(F.xxhash64("block", "record"), F.lit(SPREAD)).cast("int"))
    placed = split.withColumn("place", place).repartition("kind", "term", "place")
    merged = placed.groupBy("kind", "term", "place", "record", "block").agg(F.bit_or("word").alias("word"), F.sum("n").alias("n"))
    held = F.when(F.col("block").isNotNull(), F.bit_count("word")).when(F.col("record").isNotNull(), 1).otherwise(0)
    summed = merged.groupBy("kind", "term", "place").agg(F.sum("n").alias("n"), F.sum(held).alias("records"))
    table = cut(summed)
    light = table.where(F.col("kind") == LIGHT).select("term", "n", "records")
    high = table.where(F.col("kind") == HEAVY_TERM).groupBy("term").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
    total = table.where(F.col("kind") == ALL).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    return light.union(high), total


def term_counts(df: DataFrame, term: str, record: str) -> DataFrame:
    """(term, n, records), one row per different term."""
    return count_table(df, term, record)[0]


def marked(counts: DataFrame, records: int, rare: int = 1, common: float = 0.2) -> DataFrame:
    """Adds mark: ``rare`` up to ``rare`` records, ``common`` from ``common`` of all records on, else null."""
    return counts.withColumn(
        "mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") * (1.0 / common) >= records, "common")
    )


def marked_counts(df: DataFrame, term: str, record: str, rare: int = 1, common: float = 0.2) -> DataFrame:
    """term_counts() with marks, as shares of the different records of all rows with a term."""
    counts, total = count_table(df, term, record)
    return marked(counts, total.first()["records"], rare, common)
