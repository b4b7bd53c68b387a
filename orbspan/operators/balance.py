"""Per-key work in even time when a few keys hold most rows.

A plan is made from estimated loads before anything is moved: keys hash into a
fixed number of buckets whose loads are counted with map-side combine; only the
rows of overfull buckets are counted by key.  A key above half a task's share is
large (there are at most twice as many as tasks) and is cut into shards in
proportion to its load; shards and buckets are then packed on tasks, largest
first.  Rows go to their task directly (``repartitionById``), so the join or the
per-key function runs on the planned partitions without another exchange.

What is broadcast or sits in the plan is bounded by the numbers of buckets and
tasks, never by the data.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LoadPlan:
    keys: tuple[str, ...]
    tasks: int
    slots: list[int]  # bucket -> task
    heavy: list[tuple]  # (*key, [task of each shard])
    schema: T.StructType
    loads: list[float] = field(default_factory=list)  # planned load of each task

    def heavy_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.heavy, self.schema)


def default_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucket(keys, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def plan_load(df: DataFrame, keys: list[str], tasks: int | None = None, weight: Column | None = None) -> LoadPlan:
    """Plan for rows like those of ``df``; ``weight`` is the cost of a row, 1 by default."""
    tasks = tasks or default_tasks(df)
    buckets = max(1024, 8 * tasks)
    columns = [df[k] for k in keys]
    rows = df.select(*columns, (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w"))
    rows = rows.withColumn("__b", _bucket(keys, buckets))
    loads = [0.0] * buckets
    for b, w in rows.groupBy("__b").agg(F.sum("__w")).collect():
        loads[b] = w or 0.0
    share = sum(loads) / tasks
    full = [b for b, w in enumerate(loads) if share and w > share / 2]
    items: list[tuple[float, int, tuple | int]] = []
    heavy_rows = []
    if full:
        found = rows.where(F.col("__b").isin(full)).groupBy("__b", *keys).agg(F.sum("__w").alias("__w"))
        heavy_rows = found.where(F.col("__w") > share / 2).collect()
    heavy: dict[int, list[int]] = {}
    for i, row in enumerate(heavy_rows):
        shards = max(1, math.ceil(row["__w"] / share))
        loads[row["__b"]] -= row["__w"]
        items += [(row["__w"] / shards, 0, i)] * shards
        heavy[i] = []
    items += [(w, 1, b) for b, w in enumerate(loads)]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    heap = [(0.0, t) for t in range(tasks)]
    slots = [0] * buckets
    for w, kind, what in items:
        load, task = heapq.heappop(heap)
        heapq.heappush(heap, (load + max(w, 0.0), task))
        if kind:
            slots[what] = task
        else:
            heavy[what].append(task)
    schema = T.StructType(
        [T.StructField(f"__h_{k}", df.schema[k].dataType) for k in keys] + [T.StructField("__shards", T.ArrayType(T.IntegerType()))]
    )
    table = [(*(row[k] for k in keys), heavy[i]) for i, row in enumerate(heavy_rows)]
    return LoadPlan(tuple(keys), tasks, slots, table, schema, [x for x, _ in sorted(heap, key=lambda x: x[1])])


def _with_shards(df: DataFrame, plan: LoadPlan) -> DataFrame:
    if not plan.heavy:
        return df.withColumn("__shards", F.lit(None).cast("array<int>"))
    h = F.broadcast(plan.heavy_table(df.sparkSession))
    match = None
    for k in plan.keys:
        one = df[k].eqNullSafe(h[f"__h_{k}"])
        match = one if match is None else match & one
    return df.join(h, match, "left").drop(*[f"__h_{k}" for k in plan.keys])


def int_table(values) -> Column:
    """A literal array<int>: one string constant, as hundreds of literals slow the analysis."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _slot(plan: LoadPlan) -> Column:
    return F.element_at(int_table(plan.slots), _bucket(plan.keys, len(plan.slots)) + 1)


def assign(df: DataFrame, plan: LoadPlan, salt: str = "rows") -> DataFrame:
    """Adds ``__task``: the row's shard of a large key, else its bucket's task.

    ``salt="rows"`` spreads by the row's content, which a lost and repeated task
    reproduces whatever came before.  ``salt="position"`` also spreads identical
    rows, for input that is read from files.  Any other salt is the name of a column
    whose values stay together, as those of partial counts have to.
    """
    by = F.monotonically_increasing_id() if salt == "position" else F.xxhash64(*(df.columns if salt == "rows" else [salt]))
    df = _with_shards(df.withColumn("__salt", by), plan)
    pick = F.element_at("__shards", (F.pmod(F.xxhash64("__salt"), F.size("__shards")) + 1).cast("int"))
    return df.withColumn("__task", F.coalesce(pick, _slot(plan))).drop("__salt", "__shards")


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Adds ``__task``: one copy of the row for each task that holds a shard of its key."""
    df = _with_shards(df, plan)
    tasks = F.coalesce(F.array_distinct("__shards"), F.array(_slot(plan)))
    return df.withColumn("__task", F.explode(tasks)).drop("__shards")


def balanced_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", plan: LoadPlan | None = None, salt: str = "rows"
) -> DataFrame:
    """Join where ``left`` has the large keys: left rows are split, right rows replicated.

    ``how`` is inner, left, left_semi or left_anti.  As in SQL null keys match
    nothing.  ``plan`` may come from a cheaper table with about the same loads.
    Other columns of the same name on both sides come out twice, as in a Spark join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti.")
    plan = plan or plan_load(left, keys)
    a = assign(left, plan, salt).repartitionById(plan.tasks, "__task")
    b = replicate(right, plan).repartitionById(plan.tasks, "__task")
    return a.join(b, ["__task", *keys], how).drop("__task")


def balanced_map(df: DataFrame, keys: list[str], function, schema, plan: LoadPlan | None = None, salt: str = "rows") -> DataFrame:
    """``function(pandas) -> pandas`` for each shard of each key, on the planned tasks.

    A large key comes in several shards, so the function must give partial results
    that the caller adds up.
    """
    plan = plan or plan_load(df, keys)
    placed = assign(df, plan, salt).repartitionById(plan.tasks, "__task")
    return placed.groupBy("__task", *keys).applyInPandas(lambda pdf: function(pdf.drop(columns="__task")), schema)


def partial_counts(df: DataFrame, keys: list[str], rows: int = 1 << 17) -> DataFrame:
    """(keys..., n): the number of rows of each key among every ``rows`` rows of a task, without a shuffle.

    What is left of a key is at most one row for each ``rows`` rows, however many it has, so the
    partial counts of the largest key can go to one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted():
            table = pa.Table.from_batches(waiting).group_by(keys, use_threads=False).aggregate([([], "count_all")])
            return table.select([*keys, "count_all"]).rename_columns([*keys, "n"]).to_batches()

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield from counted()
                waiting, size = [], 0
        if size:
            yield from counted()

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType())])
    return df.select(*keys).mapInArrow(run, schema)


def counts_with_total(records: DataFrame, scope: list[str], key: str, tasks: int | None = None) -> DataFrame:
    """(scope..., key, n, total): sums of n by scope and key, each with the sum of its scope.

    ``records`` has partial counts (scope..., key, n).  The scopes are the keys of a
    fragment-replicate join with their totals: scopes are packed on tasks by the
    number of their records, a scope above half a task's share is cut into shards
    by its keys, and its total goes to the tasks of its shards only.  All partial
    counts of a key are in one shard, so they are summed where they arrive.
    """
    records = records.select(*scope, key, "n")
    plan = plan_load(records, scope, tasks)
    placed = assign(records, plan, key).repartitionById(plan.tasks, "__task")
    counts = placed.groupBy("__task", *scope, key).agg(F.sum("n").alias("n"))
    totals = records.groupBy(*scope).agg(F.sum("n").alias("total"))
    sent = replicate(totals, plan).repartitionById(plan.tasks, "__task")
    return counts.join(sent, ["__task", *scope]).drop("__task")
