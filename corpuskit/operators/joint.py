"""All task heads in one fit (C6): a block-structured multinomial loss over a shared representation.

The heads of all tasks are one weight matrix, a block of rows a task.  A row of data touches only the
block of its task, each task's loss is the mean over its own rows, and one L-BFGS run minimises
their sum, so every evaluation is one Spark job for all tasks, however many there are.  Tasks of the
job send partial gradients (classes x features numbers); these are added up in a tree, so
the driver meets about the square root of their number.

Features are hashed TF-IDF rows, brought to length one; they are written once and read by each evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import scratch_dir, ship_package

LARGEST = 64 << 20  # bytes of all heads
HISTORY = 10
DIRECT = 32  # so few partial gradients go straight to the driver
ROWS = 2048
DENSE = 1 << 19  # numbers of rows that are spread out
GRADIENT = "loss double, gradient binary"


@dataclass
class JointModel:
    """A shared encoder, the class range of each task's block, and one weight matrix (last column: intercepts)."""
    encoder: PipelineModel | None  # None where there was no row to learn from
    blocks: dict[str, tuple[int, int]]
    weights: np.ndarray

    def save(self, path: str) -> None:
        """Write the encoder, and one row a class with its task and weights, below ``path``."""
        spark = SparkSession.getActiveSession()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        rows = [(t, i - a, self.weights[i].tolist()) for t, (a, b) in self.blocks.items() for i in range(a, b)]
        spark.createDataFrame(rows, "task string, class int, weights array<double>").write.mode("overwrite").parquet(f"{path}/heads")

    @classmethod
    def load(cls, path: str) -> "JointModel":
        spark = SparkSession.getActiveSession()
        rows = spark.read.parquet(f"{path}/heads").orderBy("task", "class").collect()
        blocks: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            blocks[r["task"]] = (blocks.get(r["task"], (i, i))[0], i + 1)
        return cls(PipelineModel.load(f"{path}/encoder"), blocks, np.array([r["weights"] for r in rows]))


def encoded(model: PipelineModel, df: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` with the row's feature numbers ``i`` and values ``v`` (empty texts have none)."""
    v = model.transform(df).withColumn("_u", F.unwrap_udt("features"))
    index = F.coalesce("_u.indices", F.sequence(F.lit(0), F.size("_u.values") - 1))
    return v.select(*columns, index.alias("i"), F.col("_u.values").alias("v"))


def _sparse(batch: pa.RecordBatch, index: int, value: int):
    """(row number of each entry, feature, value) of the batch's rows, each row at length one."""
    sizes = batch.column(index).value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    v = batch.column(value).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.sqrt(np.bincount(row, weights=v * v, minlength=len(sizes)))
    return row, batch.column(index).flatten().to_numpy(zero_copy_only=False), v / length[row]


def _margins(rows: int, row, feature, value, w: np.ndarray) -> np.ndarray:
    """Products of the rows with the block ``w`` (classes x features and intercept)."""
    out = np.tile(w[:, -1], (rows, 1))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # entries are in row order
        by_feature = np.ascontiguousarray(w[:, :-1].T)
        out[row[first]] += np.add.reduceat(value[:, None] * by_feature[feature], first, axis=0)
    return out


def _slices(batches, rows: int = ROWS):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _gradients(shared):
    """Rows (block start, block end, weight of the row, label, i, v) -> the task's loss and gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        loss, gradient = 0.0, np.zeros_like(w)
        features = w.shape[1] - 1
        # few rows at a time, spread out over all features where these are not many: two matrix products, in cache
        slab = min(ROWS, DENSE // features)
        for b in _slices(batches, slab or ROWS):
            start, end, share, label = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            row, feature, value = _sparse(b, 4, 5)
            spread = None
            if slab:
                spread = np.zeros((len(start), features))
                spread[row, feature] = value
            for at in np.unique(start):
                mine = start == at
                pick = np.flatnonzero(mine)
                stop = end[pick[0]]
                if spread is not None:
                    x = spread if len(pick) == len(start) else spread[pick]
                    m = x @ w[at:stop, :-1].T + w[at:stop, -1]
                else:
                    place = np.full(len(start), -1)
                    place[pick] = np.arange(len(pick))
                    on = mine[row]
                    r, f, v = place[row[on]], feature[on], value[on]
                    m = _margins(len(pick), r, f, v, w[at:stop])
                m -= m.max(axis=1, keepdims=True)
                e = np.exp(m)
                total = e.sum(axis=1)
                y, s = label[pick], share[pick]
                loss += float((s * (np.log(total) - m[np.arange(len(pick)), y])).sum())
                d = e / total[:, None]
                d[np.arange(len(pick)), y] -= 1
                d *= s[:, None]
                gradient[at:stop, -1] += d.sum(axis=0)
                if spread is not None:
                    gradient[at:stop, :-1] += d.T @ x
                    continue
                for k in range(stop - at):
                    gradient[at + k, :-1] += np.bincount(f, weights=v * d[r, k], minlength=features)
        yield pa.record_batch([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loss, total = 0.0, None
    for b in batches:
        for a, g in zip(b.column(0).to_pylist(), b.column(1)):
            g = np.frombuffer(g.as_buffer())
            loss, total = loss + a, g.copy() if total is None else total + g
    if total is not None:
        yield pa.record_batch([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["loss", "gradient"])


def _evaluate(rows: DataFrame, w: np.ndarray, reg: float, fan_in: int) -> tuple[float, np.ndarray]:
    """Loss and gradient of all heads: one job."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    parts = rows.mapInArrow(_gradients(shared), GRADIENT)
    sums = parts.repartition(fan_in).mapInArrow(_added, GRADIENT).collect() if fan_in > 1 else parts.collect()
    shared.unpersist()
    loss, gradient = 0.0, np.zeros_like(w)
    for r in sums:
        loss += r["loss"]
        gradient += np.frombuffer(bytes(r["gradient"])).reshape(w.shape)
    flat = w.copy()
    flat[:, -1] = 0  # intercepts are not drawn to zero
    return loss + reg / 2 * float((flat ** 2).sum()), gradient + reg * flat


def minimise(evaluate, w: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS with step halving; ends when a step lowers the loss by less than ``tol`` of it."""
    loss, g = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        q, used = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * float((s * q).sum())
            used.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= float((s * y).sum()) / float((y * y).sum())
        for (s, y, rho), a in zip(steps, reversed(used)):
            q += s * (a - rho * float((y * q).sum()))
        slope, t = -float((q * g).sum()), 1.0
        if slope >= 0:
            break
        while True:
            new = w - t * q
            new_loss, new_g = evaluate(new)
            if new_loss <= loss + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = new - w, new_g - g
        done = loss - new_loss <= tol * max(abs(loss), 1e-12)
        if new_loss <= loss:
            w, loss, g = new, new_loss, new_g
        if done:
            break
        if float((s * y).sum()) > 1e-12:
            steps = [*steps, (s, y, 1 / float((s * y).sum()))][-HISTORY:]
    return w


def train_joint(df: DataFrame, num_features: int = 4096, text: str = "input_text", label: str = "input_label", task: str = "task_name",
                max_iter: int = 25, reg: float = 1e-4, tol: float = 1e-4, min_classes: int = 2) -> JointModel:
    """The shared encoder and all heads, fitted together.  Rows without a task or with a label that is null or
    negative take no part; a task has the classes up to its largest label, ``min_classes`` at least."""
    from corpuskit.operators.train import _encoder
    spark = df.sparkSession
    ship_package(spark)
    df = df.where(F.col(label).isNotNull() & F.col(task).isNotNull() & (F.col(label) >= 0)).select(F.col(task).alias("_task"), F.col(label).cast("int").alias("_label"), text)
    # one row a task, as the heads have: their size is checked below
    tasks = df.groupBy("_task").agg(F.max("_label").alias("top"), F.count("*").alias("n")).orderBy("_task").collect()
    blocks, at = {}, 0
    for r in tasks:
        blocks[r["_task"]] = (at, at := at + max(r["top"] + 1, min_classes))
    if at * (num_features + 1) * 8 > LARGEST:
        raise ValueError(f"{at} classes of {num_features} features are beyond {LARGEST} bytes of weights")
    if not blocks:
        return JointModel(None, {}, np.zeros((0, num_features + 1)))
    encoder = _encoder(text, num_features).fit(df)
    plan = spark.createDataFrame([(r["_task"], *blocks[r["_task"]], 1.0 / r["n"]) for r in tasks], "_task string, start int, end int, share double")
    path = scratch_dir(spark, "features") + "/table"
    rows = encoded(encoder, df, "_task", "_label").join(F.broadcast(plan), "_task")  # a row a task
    rows.select("start", "end", "share", F.col("_label").alias("label"), "i", F.col("v").cast("array<float>").alias("v")).write.parquet(path)
    rows = spark.read.parquet(path)
    tasks_of_job = rows.rdd.getNumPartitions()
    fan_in = int(np.sqrt(tasks_of_job)) if tasks_of_job > DIRECT else 1
    w = minimise(lambda w: _evaluate(rows, w, reg, fan_in), np.zeros((at, num_features + 1)), max_iter, tol)
    return JointModel(encoder, blocks, w)


def _predicted(blocks: dict[str, tuple[int, int]], w: np.ndarray, batch: pa.RecordBatch) -> pa.Array:
    """The preferred class of rows (task, i, v), by ROWS rows at a time."""
    def one(b: pa.RecordBatch) -> pa.Array:
        row, feature, value = _sparse(b, 1, 2)
        names = np.array([x if x is not None else "" for x in b.column(0).to_pylist()], dtype=object)
        out = np.full(len(names), -1)
        for name in set(names.tolist()) & set(blocks):
            a, z = blocks[name]
            mine = names == name
            place = np.cumsum(mine) - 1
            on = mine[row]
            out[mine] = _margins(int(mine.sum()), place[row[on]], feature[on], value[on], w[a:z]).argmax(axis=1)
        return pa.array(out, pa.int64(), mask=out < 0)
    return pa.concat_arrays([pa.array([], pa.int64())] + [one(b) for b in _slices([batch])])


def predict_joint(model: JointModel, df: DataFrame, task: str = "task_name") -> DataFrame:
    """``df`` with ``pred``, the class that the head of the row's task prefers (ties: the smaller); rows of a
    task without a head keep a null.  A batch is one product a task."""
    if not model.blocks:
        return df.withColumn("pred", F.lit(None).cast("long"))
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.blocks, model.weights))

    def run(tasks: pa.Array, i: pa.Array, v: pa.Array) -> pa.Array:
        return _predicted(*shared.value, pa.record_batch([tasks, i, v], ["t", "i", "v"]))

    feats = encoded(model.encoder, df, *df.columns)
    return feats.select(*df.columns, F.arrow_udf(run, "bigint")(F.col(task), F.col("i"), F.col("v")).alias("pred"))

