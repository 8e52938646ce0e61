"""Label standardization, encoding, validation and lookup.

P1-P4, P11, P12, P16-P18, A1, A3, J1, J4, J5, J7, U3, C1, C12.  Every operator is
a projection, a filter, an aggregate or a join on small dimension tables; the
label dimension is broadcast only after its row count is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuskit.functions.common import to_col

# The standardized hub schema.
STANDARD_SCHEMA = [("input_text", "string"), ("input_label", "bigint"), ("task_name", "string")]
# The label range each inspected task is expected to stay in.
EXPECTED_MAX = {"casehold": 4, "unfair_tos": 7, "scotus": 12, "ledgar": 99}
# Label dimensions above this many rows are joined without a broadcast hint.
BROADCAST_MAX_ROWS = 200_000


def checked_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a dimension table only when its size is proven small.

    At most ``max_rows + 1`` rows are fetched: when the table fits, those rows
    become a local relation that is broadcast (so a derived dimension is not
    computed a second time by the query); above the bound the plain DataFrame
    is returned and the optimizer picks a shuffle join.
    """
    rows = dim.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return dim
    return F.broadcast(dim.sparkSession.createDataFrame(rows, dim.schema))


def standardize_single_label(df: DataFrame, task: str, text: str = "text", label: str = "label",
                             keep=("doc_id", "split")) -> DataFrame:
    """``text -> input_text``, ``label -> input_label``, literal task name."""
    extra = [c for c in keep if c in df.columns]
    return df.select(*extra, F.col(text).alias("input_text"),
                     F.col(label).cast("bigint").alias("input_label"),
                     F.lit(task).alias("task_name"))


def first_valid_label(labels, n_classes: int) -> Column:
    """P2 rule: first list element if it lies in ``[0, n)``, else 0 (empty/null -> 0)."""
    first = F.get(to_col(labels), 0)
    return F.when(first.between(0, n_classes - 1), first).otherwise(F.lit(0)).cast("bigint")


def standardize_multi_label(df: DataFrame, task: str, n_classes: int = 8, text: str = "text",
                            labels: str = "labels", keep=("doc_id", "split"),
                            flag_missing: bool = False) -> DataFrame:
    """Multi-label rows reduced to one label; optional ``label_missing`` flag."""
    extra = [c for c in keep if c in df.columns]
    cols = [*extra, F.col(text).alias("input_text"),
            first_valid_label(labels, n_classes).alias("input_label"), F.lit(task).alias("task_name")]
    if flag_missing:
        cols.append(F.coalesce(F.size(labels) <= 0, F.lit(True)).alias("label_missing"))
    return df.select(*cols)


def cast_to_standard(df: DataFrame, keep=("doc_id", "split")) -> DataFrame:
    """Enforce the fixed 3-column schema (plus id/split), after a column-set check."""
    want = {c for c, _ in STANDARD_SCHEMA}
    missing = want - set(df.columns)
    if missing:
        raise ValueError(f"cannot cast to the standard schema, missing columns: {sorted(missing)}")
    extra = [c for c in keep if c in df.columns]
    return df.select(*extra, *[F.col(c).cast(t).alias(c) for c, t in STANDARD_SCHEMA])


def encode_label(raw, names: list[str]) -> Column:
    """P4 ``safe_label``: exact name, stripped name, then integer in range; else -1."""
    raw = to_col(raw).cast("string")
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    as_int = F.trim(raw).try_cast("bigint")
    in_range = F.when(as_int.between(0, len(names) - 1), as_int)
    return F.when(raw.isNull(), F.lit(-1).cast("bigint")).otherwise(
        F.coalesce(F.try_element_at(m, raw).cast("bigint"), F.try_element_at(m, F.trim(raw)).cast("bigint"),
                   in_range, F.lit(-1).cast("bigint")))


def standardize_corpora(corpora: dict[str, DataFrame], n_classes: dict[str, int] | None = None) -> DataFrame:
    """Per-corpus projection (P1 or P2) -> P3 -> one union; unknown names skipped."""
    n_classes = n_classes or {"unfair_tos": 8}
    parts = []
    for name, df in corpora.items():
        if name in ("scotus", "ledgar"):
            parts.append(standardize_single_label(df, name))
        elif name == "unfair_tos":
            parts.append(standardize_multi_label(df, name, n_classes.get(name, 8)))
        else:
            continue
    if not parts:
        raise ValueError("no known corpus to standardize")
    return reduce(lambda a, b: a.unionByName(b), [cast_to_standard(p) for p in parts])


def label_dimension(names_df: DataFrame, task: str = "task", names: str = "names") -> DataFrame:
    """``(task, names[])`` -> ``(task, label_id, label_name)``; tasks without
    names produce no rows (their lookups fall back to ``NoMapForTask``)."""
    return (names_df.where(F.size(names) > 0)
            .select(task, F.posexplode(names).alias("label_id", "label_name"))
            .select(F.col(task).alias("task"), F.col("label_id").cast("bigint").alias("label_id"),
                    "label_name"))


def class_encode(df: DataFrame, column: str, task: str | None = None) -> DataFrame:
    """P18 from data: names = sorted distinct values of ``column`` (a ClassLabel built
    from the column), ids = their position.  One aggregate + a window on the small
    index (range partitions) on the distinct table."""
    from corpuskit.operators.splits import ordered_index
    d = df.select(F.col(column).cast("string").alias("label_name")).where(F.col("label_name").isNotNull()).distinct()
    return ordered_index(d, ["label_name"], "label_id").select(
        F.lit(task or column).alias("task"), "label_id", "label_name")


def label_counts(dim: DataFrame) -> DataFrame:
    """A1 (D2): declared class count per task, from the label dimension."""
    return dim.groupBy("task").agg(F.count("*").alias("num_labels"))


def numbered_labels(counts: DataFrame) -> DataFrame:
    """P18 without names: ``{task}_label_{i}`` for each of a task's classes."""
    n = counts.where(F.col("num_labels") > 0)
    return (n.select("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_labels") - 1)).alias("label_id"))
            .withColumn("label_name", F.concat("task", F.lit("_label_"), F.col("label_id").cast("string"))))


def attach_label_names(df: DataFrame, dim: DataFrame, task: str = "task", label: str = "label_id",
                       out: str = "label_name", unknown: str | None = None) -> DataFrame:
    """Id -> name with ``ID_{id}_NotInMap`` / ``ID_{id}_NoMapForTask`` fall-backs, or
    with one fall-back for both, e.g. ``unknown="Unknown Label ({id})"``."""
    d = checked_broadcast(dim.select(F.col("task").alias("_t"), F.col("label_id").alias("_l"), "label_name"))
    tasks = checked_broadcast(dim.select(F.col("task").alias("_tt")).distinct())
    j = (df.join(d, (F.col(task) == F.col("_t")) & (F.col(label) == F.col("_l")), "left")
         .join(tasks, F.col(task) == F.col("_tt"), "left"))
    name = (F.when(F.col("label_name").isNotNull(), F.col("label_name"))
            .when(F.col("_tt").isNotNull(), F.concat(F.lit("ID_"), F.col(label).cast("string"), F.lit("_NotInMap")))
            .otherwise(F.concat(F.lit("ID_"), F.col(label).cast("string"), F.lit("_NoMapForTask"))))
    if unknown is not None:
        before, after = unknown.split("{id}")
        name = F.coalesce("label_name", F.concat(F.lit(before), F.coalesce(F.col(label).cast("string"), F.lit("None")), F.lit(after)))
    return j.withColumn(out, name).drop("_t", "_l", "_tt", *(["label_name"] if out != "label_name" else []))


def label_validity(df: DataFrame, counts: DataFrame, level: str = "row", batch_col: str = "batch_id",
                   task: str = "task_name", label: str = "input_label", out: str = "is_valid") -> DataFrame:
    """P11/J7 as one pass: every row with its verdict, whether the label lies in
    ``[0, n_task)``.

    ``level="row"`` judges single rows (D3); ``level="batch"`` reproduces the
    reference and refuses every row of a batch that holds one bad label.
    """
    c = checked_broadcast(counts.select(F.col("task").alias("_task"), "num_labels"))
    j = df.join(c, F.col(task) == F.col("_task"), "left")
    ok = F.coalesce((F.col(label) >= 0) & (F.col(label) < F.col("num_labels")), F.lit(False))
    j = j.withColumn(out, ok)
    if level == "batch":
        j = j.withColumn(out, F.bool_and(out).over(Window.partitionBy(batch_col)))
    return j.drop("_task", "num_labels")


def quarantine_labels(df: DataFrame, counts: DataFrame, level: str = "row", batch_col: str = "batch_id",
                      task: str = "task_name", label: str = "input_label") -> tuple[DataFrame, DataFrame]:
    """The valid rows and the refused ones; see ``label_validity``."""
    j = label_validity(df, counts, level, batch_col, task, label, "_ok")
    return j.where("_ok").drop("_ok"), j.where(~F.col("_ok")).drop("_ok")


def batch_validity(df: DataFrame, counts: DataFrame, batch_col: str = "batch_id",
                   task: str = "task_name", label: str = "input_label") -> DataFrame:
    """P11 batch rule as an aggregate: one row per batch with its verdict.  Batches
    are bounded in size, so the per-batch aggregate never builds a large group."""
    c = checked_broadcast(counts.select(F.col("task").alias("_task"), "num_labels"))
    j = df.join(c, F.col(task) == F.col("_task"), "left")
    ok = F.coalesce((F.col(label) >= 0) & (F.col(label) < F.col("num_labels")), F.lit(False))
    return j.groupBy(batch_col).agg(F.count("*").alias("n_rows"),
                                    F.bool_and(ok).alias("batch_valid"))


def out_of_range_labels(df: DataFrame, task: str = "task_name", label: str = "input_label",
                        expected_max: dict | None = None) -> DataFrame:
    """Distinct labels outside ``[0, expected_max]`` per task."""
    mx = _expected_max_col(task, expected_max)
    return (df.where(mx.isNotNull() & ~F.col(label).between(F.lit(0), mx))
            .select(F.col(task).alias("task_name"), F.col(label).alias("input_label")).distinct())


def _expected_max_col(task: str, expected_max: dict | None) -> Column:
    em = expected_max or EXPECTED_MAX
    return F.try_element_at(F.create_map(*[x for k, v in em.items() for x in (F.lit(k), F.lit(v))]), F.col(task))


def label_profile(df: DataFrame, task: str = "task_name", label: str = "input_label",
                  id_col: str = "doc_id", expected_max: dict | None = None, list_cap: int = 50) -> DataFrame:
    """Min, max, distinct count, sorted distinct labels (the first ``list_cap``
    distinct values by first appearance when there are more) and a range verdict.

    One aggregate per task on a pre-aggregated ``(task, label)`` table, so a task
    with a third of all rows still combines map-side.
    """
    from corpuskit.operators.splits import first_per_group
    per_label = df.groupBy(task, label).agg(F.min(id_col).alias("_first"))
    # per-(task, label) rows from here on; the listed labels are a two-level top-n, so a
    # task with very many distinct labels (a bad label column) is never one group
    firsts = first_per_group(per_label, list_cap, ["_first", label], task, salt_col=label)
    listed = firsts.groupBy(task).agg(F.array_join(F.sort_array(F.collect_list(label)), ",").alias("unique_labels"))
    mx = _expected_max_col(task, expected_max)
    prof = per_label.groupBy(task).agg(F.min(label).alias("min_label"), F.max(label).alias("max_label"), F.count("*").alias("num_unique"))
    listed = listed.withColumnRenamed(task, "_t")
    prof = prof.join(listed, prof[task].eqNullSafe(listed["_t"])).drop("_t")
    return prof.select(
        F.col(task).alias("task_name"), "min_label", "max_label", "num_unique", "unique_labels",
        F.when(mx.isNull(), "unknown")
        .when((F.col("min_label") < 0) | (F.col("max_label") > mx), "out_of_range")
        .otherwise("in_range").alias("verdict"))


def task_subset(df: DataFrame, counts: DataFrame, task: str = "task_name") -> DataFrame:
    """Keep rows of tasks that have a label count (left semi join)."""
    c = checked_broadcast(counts.select(F.col("task").alias(task)))
    return df.join(c, task, "left_semi")


def task_mismatch(loaded_tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """Tasks present on one side only — ``(task, side)``."""
    a = loaded_tasks.select(F.col("task")).distinct()
    b = counts.select("task").distinct()
    return (a.join(b, "task", "left_anti").withColumn("side", F.lit("loaded_without_count"))
            .unionByName(b.join(a, "task", "left_anti").withColumn("side", F.lit("count_without_data"))))


def unsupported_task(df: DataFrame, supported: DataFrame, task: str = "task") -> DataFrame:
    """Unknown task -> error text instead of an exception.  The text lists all
    supported tasks (one row, made by an aggregate and joined on a constant)."""
    names = supported.select(F.col("task").alias("_s")).distinct()
    listed = names.agg(F.array_join(F.sort_array(F.collect_list("_s")), ", ").alias("_all"), F.lit(1).alias("_one"))
    j = df.join(checked_broadcast(names), F.col(task) == F.col("_s"), "left").withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one", "left")
    err = F.when(F.col("_s").isNull(), F.concat(F.lit("Task '"), F.col(task), F.lit("' not supported. Supported tasks: ["), F.coalesce("_all", F.lit("")), F.lit("]")))
    return j.withColumn("error", err).drop("_s", "_one", "_all")


def check_task_counts(df: DataFrame, counts: DataFrame, task: str = "task_name") -> None:
    """Raise when a task with rows has no label count, or more than one."""
    c = counts.groupBy("task").agg(F.count("*").alias("n"))
    bad = (df.select(F.col(task).alias("task")).distinct().join(c, "task", "left").where(F.coalesce(F.col("n"), F.lit(0)) != 1)
           .agg(F.count("*").alias("k"), F.array_join(F.slice(F.sort_array(F.collect_list("task")), 1, 20), ", ").alias("names")).first())
    if bad["k"]:
        raise ValueError(f"{bad['k']} task(s) without exactly one label count: {bad['names']}")
