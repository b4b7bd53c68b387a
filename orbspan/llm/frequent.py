"""Most frequent items: space-saving summaries, merged in a tree, then counted exactly.

A summary holds at most ``counters`` items with an upper bound of their count and
the part of it that may be error.  Batches are counted exactly and merged into the
partition's summary; an item that a full summary does not hold may have had its
smallest count.  Every item with at least N / counters rows is held, and no bound
is off by more than N / counters.  Null is no item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 32
_BATCH = 1 << 17


class Summary:
    """Items with upper bounds; ``floor`` bounds any item that is not held."""

    def __init__(self, counters: int, kind: pa.DataType):
        self.counters, self.rows, self.floor = counters, 0, 0
        self.items, self.count, self.error = pa.array([], kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, items: pa.Array, count: np.ndarray, error: np.ndarray, floor: int, rows: int) -> None:
        """Merge another summary; exact counts have error and floor 0."""
        both = pa.chunked_array([self.items, items]).combine_chunks()
        n = len(self.items)
        code = pc.dictionary_encode(both)
        index = code.indices.to_numpy(zero_copy_only=False)
        many = len(code.dictionary)
        total, wrong = np.zeros(many, np.int64), np.zeros(many, np.int64)
        held, given = np.zeros(many, bool), np.zeros(many, bool)
        held[index[:n]], given[index[n:]] = True, True
        np.add.at(total, index, np.r_[self.count, count])
        np.add.at(wrong, index, np.r_[self.error, error])
        missing = np.where(held, 0, self.floor) + np.where(given, 0, floor)
        total, wrong, self.floor = total + missing, wrong + missing, self.floor + floor
        self.rows += rows
        items = code.dictionary
        if many > self.counters:
            keep = np.argpartition(total, many - self.counters - 1)
            self.floor = max(self.floor, int(total[keep[many - self.counters - 1]]))
            keep = keep[many - self.counters :]
            items, total, wrong = items.take(pa.array(keep)), total[keep], wrong[keep]
        self.items, self.count, self.error = items, total, wrong

    def batch(self, node: int, names: list[str]) -> pa.RecordBatch:
        """The summary as rows; the row without an item holds the number of rows and the floor."""
        items = pa.concat_arrays([self.items, pa.nulls(1, self.items.type)])
        columns = [pa.array(np.full(len(items), node, np.int32)), items, pa.array(np.r_[self.count, self.rows]), pa.array(np.r_[self.error, self.floor])]
        return pa.RecordBatch.from_arrays(columns, names)


_NAMES = ["node", "item", "count", "error"]


def summaries(df: DataFrame, item: str, counters: int) -> DataFrame:
    """(node, item, count, error): one summary a partition."""
    from pyspark import TaskContext

    kind = df.schema[item].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, waiting, size = None, [], 0

        def flush():
            values = pc.drop_null(pa.chunked_array(waiting))
            counted = pc.value_counts(values)
            n = counted.field("counts").to_numpy(zero_copy_only=False)
            summary.add(counted.field("values"), n, np.zeros(len(n), np.int64), 0, len(values))

        for batch in batches:
            column = batch.column(0)
            summary = summary or Summary(counters, column.type)
            waiting.append(column)
            size += len(column)
            if size >= _BATCH:
                flush()
                waiting, size = [], 0
        if summary is not None:
            if waiting:
                flush()
            yield summary.batch(TaskContext.get().partitionId(), _NAMES)

    return df.select(item).mapInArrow(run, _schema(kind))


def _schema(kind) -> T.StructType:
    return T.StructType(
        [T.StructField("node", T.IntegerType()), T.StructField("item", kind), T.StructField("count", T.LongType()), T.StructField("error", T.LongType())]
    )


def merge_tree(parts: DataFrame, counters: int) -> DataFrame:
    """One summary from those of all partitions: FAN_IN of them, FAN_IN of these, then all that are left.

    The depth is fixed, so the plan need not know how many partitions there are;
    the last task merges one summary for each FAN_IN ** 2 partitions.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        out = Summary(counters, table.schema.field("item").type)
        column = table.column("item").combine_chunks()
        owner, count, error = (table.column(c).to_numpy() for c in ("part", "count", "error"))
        total = pc.is_null(column).to_numpy(zero_copy_only=False)
        for part in np.unique(owner):
            rows, end = np.flatnonzero((owner == part) & ~total), np.flatnonzero((owner == part) & total)[0]
            out.add(column.take(pa.array(rows)), count[rows], error[rows], int(error[end]), int(count[end]))
        return pa.Table.from_batches([out.batch(node, _NAMES)])

    schema = parts.schema
    for wide in (FAN_IN, FAN_IN, None):
        step = parts.withColumnRenamed("node", "part")
        step = step.withColumn("node", F.floor(F.col("part") / wide).cast("int") if wide else F.lit(0))
        parts = step.groupBy("node").applyInArrow(run, schema)
    return parts.drop("node")


def space_saving(df: DataFrame, item: str, counters: int) -> DataFrame:
    """(item, count, error): the merged summary, and its row without an item with (rows, floor)."""
    return merge_tree(summaries(df, item, counters), counters)


def frequent_items(df: DataFrame, item: str, share: float, slack: int = 10, exact: bool = True) -> DataFrame:
    """(item, n, error) of the values with at least ``share`` of all rows that are not null.

    The summary has slack / share counters, so its bounds are off by at most
    share / slack of the rows.  With ``exact`` a second pass counts the surviving
    candidates, at most as many as counters, and error is 0; without it n is the
    upper bound and all values that may reach the share are given.
    """
    kept = space_saving(df, item, math.ceil(slack / share)).collect()
    rows = sum(r["count"] for r in kept if r["item"] is None)
    found = [(r["item"], r["count"], r["error"]) for r in kept if r["item"] is not None and r["count"] * (1.0 / share) >= rows]
    kind = df.schema[item].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("n", T.LongType()), T.StructField("error", T.LongType())])
    spark = df.sparkSession
    listed = spark.createDataFrame(found, schema)
    if not exact:
        return listed
    asked = F.broadcast(listed.select(F.col("item").alias("__item")))
    counted = df.select(item).join(asked, F.col(item) == F.col("__item")).groupBy("__item").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") * (1.0 / share) >= rows).select(F.col("__item").alias("item"), "n", F.lit(0).cast("bigint").alias("error"))


