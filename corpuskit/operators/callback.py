"""User metrics over distributed rows (metric callback, SURVEY 2.11).

A metric is three functions: ``partial(table)`` makes a state of an Arrow table of one group's rows, ``merge(a, b)`` joins two
states, ``finish(state)`` gives the figures.  Tasks fold their batches, then states are merged in a tree of
``fan_in`` a step, so no group's rows, and no group's states, meet in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import scratch_dir, ship_package

HELD = 10_000  # groups whose states a task holds at once
STATE = "group_key string, node long, state binary"


def _fold(partial: Callable, merge: Callable, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), {}

        def out():
            rows = [(k, part, pickle.dumps(v)) for k, v in held.items()]
            held.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                                   ["group_key", "node", "state"])

        for b in batches:
            table = pa.Table.from_batches([b])
            keys = table["group_key"].to_pylist()
            rows: dict = {}
            for i, k in enumerate(keys):
                rows.setdefault(k, []).append(i)
            table = table.drop(["group_key"])
            for k, at in rows.items():
                state = partial(table.take(at) if len(rows) > 1 else table)
                held[k] = merge(held[k], state) if k in held else state
            if len(held) >= HELD:
                yield out()
        yield out()
    return run


def _merged(merge: Callable, fan_in: int):
    """Rows sorted by (group_key, node) -> one state for each node of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        row = lambda: pa.record_batch([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())],
                                      ["group_key", "node", "state"])
        for b in batches:
            for k, node, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (k, node // fan_in) != now:
                    if now is not None:
                        yield row()
                    now, state = (k, node // fan_in), pickle.loads(raw.as_py())
                else:
                    state = merge(state, pickle.loads(raw.as_py()))
        if now is not None:
            yield row()
    return run


def evaluate_with(df: DataFrame, columns: list[str], partial: Callable, merge: Callable, finish: Callable, figures: list[str],
                  group: str | None = None, fan_in: int = 32) -> DataFrame:
    """``(group, figures...)``: a user's metric over ``columns``, for every value of ``group`` (null is one) or for all rows.

    ``finish`` returns a dict with the ``figures`` as floats.  ``merge`` must not depend on the order of states.
    The functions travel to the tasks, so they must be picklable with what they use; no rows give no result row."""
    spark = df.sparkSession
    ship_package(spark)
    key = F.col(group).cast("string") if group else F.lit(None).cast("string")
    path = scratch_dir(spark, "states")
    df.select(*columns, key.alias("group_key")).mapInArrow(_fold(partial, merge, group is not None), STATE).write.parquet(f"{path}/0")
    level = 0
    while True:
        states = spark.read.parquet(f"{path}/{level}")
        most = states.agg(F.max("node")).first()[0]
        # a task that let go of its states early has sent several of one node, so the last level is merged as well
        level += 1
        next_node = F.floor(F.col("node") / fan_in).cast("long")
        (states.withColumn("_next", next_node).repartition("group_key", "_next").sortWithinPartitions("group_key", "node").drop("_next")
         .mapInArrow(_merged(merge, fan_in), STATE).write.parquet(f"{path}/{level}"))
        if not most or most < fan_in:
            break

    def figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [finish(pickle.loads(raw.as_py())) for raw in b.column(2)]
            yield pa.record_batch([b.column(0), *[pa.array([None if f[x] is None else float(f[x]) for f in found], pa.float64()) for x in figures]], ["group_key", *figures])
    out = spark.read.parquet(f"{path}/{level}").mapInArrow(figures_of, "group_key string, " + ", ".join(f"{x} double" for x in figures))
    return out.withColumnRenamed("group_key", group) if group else out.drop("group_key")
