"""Reproducible splits, caps, first-n, task-pure batches and global indexing.

L1-L6, W1, W2, W7, J3, U1, U5, A16.  Randomness is an md5 hash of (id, seed), so
every result is independent of partitioning (``randomSplit`` is not: it changes
with the partition layout).  Windows only run on small derived tables (tasks,
batches) or are partitioned by (task, range partition) so no single task is one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuskit.functions.common import md5_bucket
from corpuskit.session import scratch_dir

def hash_order(id_col: str, seed) -> Column:
    """A deterministic pseudo-random sort key: md5 of id ‖ seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


HASH_RANGE = 1 << 32


def hash_split(df: DataFrame, id_col: str, ratios: dict[str, float], seed=42,
               out: str = "split") -> DataFrame:
    """The first 32 bits of md5(id‖seed) against the cumulative ratios times 2^32;
    the last split takes the rest.  Narrow: no shuffle, no action."""
    b = md5_bucket(id_col, seed, HASH_RANGE)
    acc, expr = 0.0, None
    *firsts, last = ratios
    for name in firsts:
        acc += ratios[name]
        hit = b < round(acc * HASH_RANGE)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return df.withColumn(out, F.lit(last) if expr is None else expr.otherwise(F.lit(last)))


def _has(df: DataFrame, split_col: str, names: list[str]) -> dict[str, bool]:
    """Which of the named splits have rows: one aggregate, whatever the number of splits."""
    r = df.agg(*[F.coalesce(F.bool_or(F.col(split_col) == n), F.lit(False)).alias(n) for n in names]).first()
    return r.asDict()


def split_missing_validation(df: DataFrame, id_col: str, seed=42, split_col: str = "split") -> DataFrame:
    """L3: if no ``validation`` split exists, carve 20 % of ``train`` (or of ``test``
    when only ``test`` exists) as validation, deterministically."""
    have = _has(df, split_col, ["train", "validation", "test"])
    source = "train" if have["train"] else ("test" if have["test"] else None)
    if have["validation"] or source is None:
        return df
    b = md5_bucket(id_col, seed)
    return df.withColumn(split_col, F.when((F.col(split_col) == source) & (b >= 80), F.lit("validation"))
                         .otherwise(F.col(split_col)))


def three_way_split(df: DataFrame, id_col: str, seed=42, out: str = "split") -> DataFrame:
    """L4: seeded 80/10/10 in two steps — 80/20 on the first hash, then the 20 %
    halved on a second, independent hash."""
    b1 = md5_bucket(id_col, seed)
    b2 = md5_bucket(id_col, f"{seed}b")
    return df.withColumn(out, F.when(b1 < 80, "train").when(b2 < 50, "validation").otherwise("test"))


def ensure_splits(df: DataFrame, id_col: str, seed=42, split_col: str = "split") -> DataFrame:
    """L6 + U1: keep the given splits if train, validation and test all exist;
    otherwise union everything and re-split 80/10/10."""
    if all(_has(df, split_col, ["train", "validation", "test"]).values()):
        return df
    return three_way_split(df.drop(split_col), id_col, seed, split_col)


def first_n(df: DataFrame, n: int, id_col: str, split_col: str | None = None, split: str | None = None) -> DataFrame:
    """L1: first ``n`` rows by id (TakeOrderedAndProject: top-n per partition, then merge)."""
    if split_col and split:
        df = df.where(F.col(split_col) == split)
    return df.orderBy(id_col).limit(n)


def first_per_group(df: DataFrame, n: int, order: str | list[str], group: str, salt_buckets: int = 64, salt_col: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``order`` of every group, however many groups there are (the
    two levels of ``cap_rows``, with one bound for all)."""
    order = [order] if isinstance(order, str) else order
    sb = F.abs(F.xxhash64(F.col(salt_col or order[0]))) % salt_buckets
    level1 = (df.withColumn("_sb", sb).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_sb").orderBy(*order)))
              .where(F.col("_r") <= n).drop("_sb"))
    return (level1.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .where(F.col("_r") <= n).drop("_r"))


def cap_rows(df: DataFrame, caps: dict[str, int], id_col: str, split_col: str = "split",
             salt_buckets: int = 64) -> DataFrame:
    """L2: keep the first ``caps[split]`` rows of each split by id.

    Two-level top-k so no split becomes one window group: rows are ranked inside
    (split, hash bucket) groups, only each bucket's first ``cap`` rows survive
    (Spark plans the ``row_number() <= cap`` filter as a map-side group limit),
    and the final rank runs on at most ``cap * salt_buckets`` rows per split.
    """
    cap = F.try_element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]),
                           F.col(split_col))
    sb = F.abs(F.xxhash64(F.col(id_col))) % salt_buckets
    top = max(caps.values())   # a literal bound lets Spark plan a group limit
    stage1 = (df.withColumn("_cap", cap).where(F.col("_cap").isNotNull()).withColumn("_sb", sb)
              .withColumn("_r1", F.row_number().over(Window.partitionBy(split_col, "_sb").orderBy(id_col)))
              .where(F.col("_r1") <= top).where(F.col("_r1") <= F.col("_cap")))
    stage2 = (stage1.withColumn("_r2", F.row_number().over(Window.partitionBy(split_col).orderBy(id_col)))
              .where(F.col("_r2") <= top))
    keep_uncapped = df.where(~F.col(split_col).isin(*caps.keys()) | F.col(split_col).isNull())
    capped = stage2.where(F.col("_r2") <= F.col("_cap")).drop("_cap", "_sb", "_r1", "_r2")
    return capped.unionByName(keep_uncapped)


def task_counts(df: DataFrame, task: str = "task_name") -> DataFrame:
    return df.groupBy(task).agg(F.count("*").alias("n_rows"))


def task_offsets(df: DataFrame, task: str = "task_name", task_order: list[str] | None = None) -> DataFrame:
    """Cumulative row offset of each task (tasks in the given order, else by
    name).  The window runs on the per-task count table — one row per task."""
    c = task_counts(df, task)
    if task_order:
        ordk = F.array_position(F.array(*[F.lit(t) for t in task_order]), F.col(task))
    else:
        ordk = F.col(task)
    w = Window.orderBy(ordk).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("offset", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).cast("bigint"))


def _dealt(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """The rows in sorted range partitions of the keys, written once, with their partition ``_b`` and a number
    ``_m`` that grows with the keys' order.  Spark samples the bounds, so any type and spread of keys will do.
    All columns are written: drop texts that are not needed beforehand."""
    spark = df.sparkSession
    path = scratch_dir(spark, "ranked") + "/table"
    dealt = df.repartitionByRange(buckets, *keys) if buckets else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path).withColumn("_b", F.shiftright("_m", 33))


def range_bucket(df: DataFrame, key: str, out: str, buckets: int | None = None) -> DataFrame:
    """``df`` with a bucket number that grows with the key; buckets hold about equally many rows however
    the keys are spread; null keys are in bucket -1."""
    rows = _dealt(df, [key], buckets).withColumnRenamed("_b", "_part")
    return rows.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1).cast("bigint")).otherwise(F.col("_part"))).drop("_m", "_part")


def _local_index(df: DataFrame, id_col: str, task: str | None, buckets: int | None = None,
                 out: str = "local_idx", weight: str | None = None, order: list[str] | None = None) -> DataFrame:
    """0-based rank of each row inside its task by ``id_col`` (keys unique per
    task; with ties the ranks are still a permutation).

    No window ever spans a whole task: rows go once to range partitions of (task, key), whatever the
    keys' type and spread, and are written sorted and numbered.  A task's rows before a
    partition are prefix-summed on the small (task, partition) table, and a row's rank follows from
    its number.  With ``weight`` the result is the exclusive prefix sum of the weights instead of
    the row rank; ``order`` breaks ties of the key.
    """
    by = [task] if task is not None else []
    rows = _dealt(df, [*by, id_col, *(order or [])], buckets)
    wcol = F.col(weight) if weight else F.lit(1)
    sizes = rows.groupBy(*by, "_b").agg(F.sum(wcol).alias("_n"), F.min("_m").alias("_first"))
    w = (Window.partitionBy(*by) if by else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    inner = Window.partitionBy(*by, "_b").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(c).alias(f"_s{c}") for c in (*by, "_b")], "_start", "_first")
    on = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in (*by, "_b")]
    if weight:
        rows = rows.withColumn("_local", F.coalesce(F.sum(wcol).over(inner), F.lit(0)))
    rows = rows.join(starts, on)
    local = F.col("_local") if weight else F.col("_m") - F.col("_first")
    return (rows.withColumn(out, (F.col("_start") + local).cast("bigint"))
            .drop("_m", "_b", "_start", "_first", *(["_local"] if weight else []), *[f"_s{c}" for c in (*by, "_b")]))


def ordered_index(df: DataFrame, order_cols: list[str], out: str = "idx", buckets: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``order_cols``."""
    return _local_index(df, order_cols[0], None, buckets, out, order=order_cols[1:])


def global_index(df: DataFrame, id_col: str = "doc_id", task: str = "task_name",
                 task_order: list[str] | None = None) -> DataFrame:
    """``global_idx = offset(task) + local_idx`` (rows of a task by id)."""
    offs = task_offsets(df, task, task_order).select(F.col(task).alias("_task"), "offset")
    return (_local_index(df, id_col, task).join(offs, F.col(task).eqNullSafe(F.col("_task")))
            .withColumn("global_idx", F.col("offset") + F.col("local_idx")).drop("offset", "_task"))


def task_batches(df: DataFrame, batch_size: int, seed=42, id_col: str = "doc_id",
                 task: str = "task_name") -> DataFrame:
    """Task-pure batches — rows shuffled inside their task by md5(seed‖id),
    then cut into chunks of ``batch_size``; the last chunk may be short.

    The shuffle order is a hash key, so the position of a row is its rank by that
    key inside the task — computed like ``global_index`` (bucketed ranks, no single
    window over a whole task).
    """
    keyed = df.withColumn("_k", F.conv(F.substring(hash_order(id_col, seed), 1, 15), 16, 10).cast("bigint"))
    ranked = _local_index(keyed, "_k", task).withColumnRenamed("local_idx", "pos_in_task")
    return (ranked.withColumn("batch_no", F.floor(F.col("pos_in_task") / batch_size).cast("bigint"))
            .withColumn("batch_id", F.concat_ws(":", F.col(task), F.col("batch_no").cast("string")))
            .drop("_k"))


def batch_order(batches: DataFrame, seed=42, task: str = "task_name") -> DataFrame:
    """Shuffled order of the batches across tasks.  Runs on the batch table
    (one row per batch, never on the rows), ranked by a hash key with the
    bucketed rank, so even a huge batch table is not one window group."""
    b = batches.select(task, "batch_no", "batch_id").distinct()
    key = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col("batch_id"))), 1, 15), 16, 10).cast("bigint")
    return _local_index(b.withColumn("_key", key), "_key", None, out="epoch_pos").drop("_key")


def batch_counts(df: DataFrame, batch_size: int, task: str = "task_name") -> DataFrame:
    """``ceil(n / B)`` batches per task plus the epoch total (rollup)."""
    c = task_counts(df, task).withColumn("n_batches", F.ceil(F.col("n_rows") / batch_size).cast("bigint"))
    total = c.agg(F.lit(None).cast("string").alias(task), F.sum("n_rows").alias("n_rows"),
                  F.sum("n_batches").alias("n_batches"))
    return c.unionByName(total)


def batch_coverage(df: DataFrame, batches: DataFrame, cols: list[str]) -> DataFrame:
    """Rows missing from / extra in the batched set (both should be empty)."""
    a = df.select(*cols)
    b = batches.select(*cols)
    return (a.exceptAll(b).withColumn("side", F.lit("missing"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("extra"))))


def union_splits(dfs: list[DataFrame]) -> DataFrame:
    """Union all splits (by name) before re-splitting."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
