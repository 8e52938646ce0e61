"""Catalog entries for splits, caps, batches and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import labels as L
from corpuskit.operators import splits as S
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import duck_task_counts, register, task_counts_df
from corpuskit.plans.q_labels import std, std4, with_std
from corpuskit.session import scratch_dir
from corpuskit.sources import io

B = 16
SEED = 42


def _k(expr: str) -> str:
    """DuckDB twin of the 60-bit hash sort key."""
    return f"('0x'||substr(md5({expr}),1,15))::BIGINT"


@register("read_splits", with_std() + "SELECT doc_id, input_text, input_label, task_name, split FROM std")
def q_read_splits(spark, d):
    path = scratch_dir(spark, "splits")
    io.write_splits(std(spark, d), path, mode="overwrite")
    return io.read_splits(spark, path).select("doc_id", "input_text", "input_label", "task_name", "split")


@register("split_fallback", fx.duck_with("v_scotus") + "SELECT doc_id, split FROM v_scotus WHERE split = "
          "(SELECT split FROM v_scotus ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 "
          "WHEN 'test' THEN 2 ELSE 3 END, split LIMIT 1)")
def q_split_fallback(spark, d):
    return io.read_split(fx.v_scotus(spark, d), "dev").select("doc_id", "split")


@register("rows_per_split", with_std(std4_needed=True) +
          "SELECT split, count(*) AS n_rows, grouping(split) > 0 AS is_total FROM std4 GROUP BY ROLLUP (split)")
def q_rows_per_split(spark, d):
    from corpuskit.operators.profile import rows_per_split
    return rows_per_split(std4(spark, d))


@register("first_n", fx.duck_with("v_scotus") +
          "SELECT doc_id, label FROM v_scotus WHERE split = 'train' ORDER BY doc_id LIMIT 5")
def q_first_n(spark, d):
    return S.first_n(fx.v_scotus(spark, d), 5, "doc_id", "split", "train").select("doc_id", "label")


@register("cap_rows", fx.duck_with("v_unfair") +
          "SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) rn "
          "FROM v_unfair) WHERE (split = 'train' AND rn <= 600) OR (split = 'validation' AND rn <= 1000) "
          "OR split NOT IN ('train', 'validation')")
def q_cap_rows(spark, d):
    return S.cap_rows(fx.v_unfair(spark, d), {"train": 600, "validation": 1000}, "doc_id").select("doc_id", "split")


@register("split_missing_validation", fx.duck_with("v_scotus") +
          f"SELECT doc_id, CASE WHEN split = 'train' AND {fx.duck_bucket('doc_id', str(SEED))} >= 80 "
          "THEN 'validation' ELSE split END AS split FROM v_scotus WHERE split <> 'validation'")
def q_split_missing_validation(spark, d):
    df = fx.v_scotus(spark, d).where(F.col("split") != "validation")
    return S.split_missing_validation(df, "doc_id", SEED).select("doc_id", "split")


_THREE = (f"CASE WHEN {fx.duck_bucket('{c}', str(SEED))} < 80 THEN 'train' "
          f"WHEN {fx.duck_bucket('{c}', str(SEED) + 'b')} < 50 THEN 'validation' ELSE 'test' END")


@register("hash_split", "SELECT doc_id, CASE WHEN h < round(0.805 * 4294967296) THEN 'train' WHEN h < round(0.9 * 4294967296) THEN 'validation' "
          "ELSE 'test' END AS split FROM (SELECT doc_id, ('0x'||substr(md5(doc_id::VARCHAR || '7'),1,8))::BIGINT AS h FROM documents)")
def q_hash_split_exact(spark, d):
    return S.hash_split(fx.documents(spark, d), "doc_id", {"train": 0.805, "validation": 0.095, "test": 0.1}, 7).select("doc_id", "split")


@register("hash_split_80_10_10", f"SELECT doc_id, {_THREE.format(c='doc_id')} AS split FROM documents")
def q_hash_split(spark, d):
    return S.three_way_split(fx.documents(spark, d), "doc_id", SEED).select("doc_id", "split")


@register("resplit_or_keep", fx.duck_with("v_turk") +
          f"SELECT conv_id, {_THREE.format(c='conv_id')} AS split FROM v_turk")
def q_resplit_or_keep(spark, d):
    t = fx.v_turk(spark, d).withColumn("split", F.lit("train"))
    return S.ensure_splits(t, "conv_id", SEED).select("conv_id", "split")


@register("union_splits", fx.duck_with("v_scotus") +
          f"SELECT doc_id, {_THREE.format(c='doc_id')} AS split FROM v_scotus")
def q_union_splits(spark, d):
    v = fx.v_scotus(spark, d)
    parts = [v.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    return S.three_way_split(S.union_splits(parts), "doc_id", SEED).select("doc_id", "split")


def _train_labels(spark, d):
    """What is numbered: no texts, as every column given is written with its rank."""
    return std(spark, d, splits=["train"]).select("doc_id", "task_name", "input_label")


_BATCH_CTE = {"bt": "SELECT doc_id, task_name, input_label, (row_number() OVER (PARTITION BY task_name ORDER BY "
                    f"{_k(f"doc_id::VARCHAR || '{SEED}'")}) - 1)::BIGINT AS pos_in_task FROM std WHERE split = 'train'",
              "bt2": f"SELECT *, (pos_in_task // {B})::BIGINT AS batch_no, "
                     "task_name || ':' || (pos_in_task // 16)::VARCHAR AS batch_id FROM bt"}


def _batches(spark, d):
    return S.task_batches(_train_labels(spark, d), B, SEED)


@register("task_batches", with_std(extra=_BATCH_CTE) + "SELECT doc_id, task_name, pos_in_task, batch_no FROM bt2")
def q_task_batches(spark, d):
    return _batches(spark, d).select("doc_id", "task_name", "pos_in_task", "batch_no")


@register("batch_order", with_std(extra=_BATCH_CTE) +
          "SELECT batch_id, (row_number() OVER (ORDER BY " + _k(f"'{SEED}' || batch_id") + ") - 1)::BIGINT AS epoch_pos "
          "FROM (SELECT DISTINCT batch_id FROM bt2)")
def q_batch_order(spark, d):
    return S.batch_order(_batches(spark, d), SEED).select("batch_id", "epoch_pos")


@register("batch_counts", with_std() +
          f"SELECT task_name, count(*) AS n_rows, ceil(count(*) / {B})::BIGINT AS n_batches FROM std "
          "WHERE split = 'train' GROUP BY task_name UNION ALL "
          f"SELECT NULL, sum(n)::BIGINT, sum(nb)::BIGINT FROM (SELECT count(*) n, ceil(count(*) / {B})::BIGINT nb FROM std "
          "WHERE split = 'train' GROUP BY task_name)")
def q_batch_counts(spark, d):
    return S.batch_counts(std(spark, d, splits=["train"]), B)


@register("batch_coverage", with_std(extra=_BATCH_CTE) +
          "SELECT doc_id, task_name, 'missing' AS side FROM (SELECT doc_id, task_name FROM std WHERE split='train' "
          "EXCEPT ALL SELECT doc_id, task_name FROM bt2) UNION ALL SELECT doc_id, task_name, 'extra' FROM "
          "(SELECT doc_id, task_name FROM bt2 EXCEPT ALL SELECT doc_id, task_name FROM std WHERE split='train')")
def q_batch_coverage(spark, d):
    return S.batch_coverage(std(spark, d, splits=["train"]), _batches(spark, d), ["doc_id", "task_name"])


@register("batch_drop_invalid", with_std(std4_needed=True, extra={
    "counts": duck_task_counts(),
    "bt": "SELECT doc_id, task_name, input_label, (row_number() OVER (PARTITION BY task_name ORDER BY "
          f"{_k(f"doc_id::VARCHAR || '{SEED}'")}) - 1)::BIGINT AS pos_in_task FROM std4 WHERE split = 'train'"}) +
          f"SELECT task_name || ':' || (pos_in_task // {B})::VARCHAR AS batch_id, count(*) AS n_rows, "
          "bool_and(coalesce(input_label >= 0 AND input_label < c.num_labels, false)) AS batch_valid "
          "FROM bt LEFT JOIN counts c ON c.task = bt.task_name GROUP BY 1")
def q_batch_drop_invalid(spark, d):
    b = S.task_batches(std4(spark, d).where(F.col("split") == "train").select("doc_id", "task_name", "input_label"), B, SEED)
    return L.batch_validity(b, task_counts_df(spark))


@register("task_offsets", with_std() +
          "SELECT task_name, n_rows, coalesce(sum(n_rows) OVER (ORDER BY task_name ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT task_name, count(*) AS n_rows FROM std "
          "WHERE split = 'train' GROUP BY task_name)")
def q_task_offsets(spark, d):
    return S.task_offsets(std(spark, d, splits=["train"]))


@register("global_index", with_std() +
          "SELECT doc_id, task_name, local_idx, off + local_idx AS global_idx FROM ("
          "SELECT doc_id, task_name, (row_number() OVER (PARTITION BY task_name ORDER BY doc_id) - 1)::BIGINT AS local_idx "
          "FROM std WHERE split = 'train') JOIN (SELECT task_name, coalesce(sum(n) OVER (ORDER BY task_name ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (SELECT task_name, count(*) n FROM std "
          "WHERE split = 'train' GROUP BY 1)) USING (task_name)")
def q_global_index(spark, d):
    return S.global_index(_train_labels(spark, d)).select("doc_id", "task_name", "local_idx", "global_idx")
