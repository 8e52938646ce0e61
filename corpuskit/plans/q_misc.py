"""Catalog entries for profiling, the label-count file, training and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import profile as PR
from corpuskit.operators import train as TRN
from corpuskit.operators.scoring import process_document
from corpuskit.plans import fixtures as fx
from corpuskit.plans import q_scoring as SQ
from corpuskit.plans.catalog import register
from corpuskit.plans.q_labels import DUCK_DATA_DIM, _data_dimension, std, std4, with_std
from corpuskit.session import scratch_dir
from corpuskit.sources import io
from corpuskit.streaming import stream as ST


@register("sample_label_range", with_std(std4_needed=True) +
          "SELECT task_name, min(input_label) AS sample_min, max(input_label) AS sample_max, count(*) AS sample_rows "
          "FROM (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY doc_id) AS rn FROM std4 "
          "WHERE split = 'train') WHERE rn <= 1000 GROUP BY task_name")
def q_sample_label_range(spark, d):
    return PR.sample_label_range(std4(spark, d).where(F.col("split") == "train"), "doc_id", "input_label",
                                 "task_name", 1000)


def _dv_sql(col: str, src: str = "documents") -> str:
    return (f"SELECT '{col}' AS column, count(*) AS n_distinct, CASE WHEN count(*) < 20 THEN "
            f"array_to_string(list_transform(list_sort(list(v), 'ASC', 'NULLS LAST'), lambda x: coalesce(x, 'None')), '|') END AS values "
            f"FROM (SELECT DISTINCT {col}::VARCHAR AS v FROM {src})")


@register("distinct_values", fx.duck_with("v_unfair") + _dv_sql("lang") + " UNION ALL " + _dv_sql("source") +
          " UNION ALL " + _dv_sql("labels", "v_unfair"))
def q_distinct_values(spark, d):
    docs = fx.table(spark, d, "documents")
    return (PR.distinct_values(docs, "lang").unionByName(PR.distinct_values(docs, "source"))
            .unionByName(PR.distinct_values(fx.v_unfair(spark, d), "labels")))


def _describe_num(col: str) -> str:
    base = (f"SELECT '{col}' AS column, stat, round(value, 6) AS value_num, NULL::VARCHAR AS value_str FROM "
            f"(SELECT count({col})::DOUBLE AS count, avg({col})::DOUBLE AS mean, stddev_samp({col})::DOUBLE AS std, "
            f"min({col})::DOUBLE AS min, max({col})::DOUBLE AS max, "
            f"quantile_cont({col}, 0.25)::DOUBLE AS q25, quantile_cont({col}, 0.5)::DOUBLE AS q50, "
            f"quantile_cont({col}, 0.75)::DOUBLE AS q75 FROM documents) "
            "UNPIVOT (value FOR stat IN (count, mean, std, min, max, q25 AS '25%', q50 AS '50%', q75 AS '75%'))")
    return base


def _describe_str(col: str) -> str:
    return (f"SELECT '{col}' AS column, 'count' AS stat, count({col})::DOUBLE AS value_num, NULL::VARCHAR AS value_str "
            f"FROM documents UNION ALL SELECT '{col}', 'unique', count(*)::DOUBLE, NULL FROM "
            f"(SELECT DISTINCT {col} FROM documents WHERE {col} IS NOT NULL) UNION ALL "
            f"SELECT '{col}', 'top', NULL, arg_min(v, (-f, v)) FROM (SELECT {col}::VARCHAR AS v, count(*) AS f "
            f"FROM documents WHERE {col} IS NOT NULL GROUP BY 1) UNION ALL "
            f"SELECT '{col}', 'freq', max(f)::DOUBLE, NULL FROM (SELECT count(*) AS f FROM documents "
            f"WHERE {col} IS NOT NULL GROUP BY {col})")


@register("describe_columns", " UNION ALL ".join([_describe_num("n_chars"), _describe_num("doc_id"),
                                                 _describe_str("lang"), _describe_str("source"), _describe_str("text")]))
def q_describe_columns(spark, d):
    docs = fx.table(spark, d, "documents")
    return PR.describe_columns(docs)


@register("profile_column",
          "SELECT 'source' AS column, 'string' AS dtype, (SELECT count(*) FROM documents) AS n_rows, "
          "(SELECT count(*) FROM documents WHERE source IS NULL) AS n_null, n_distinct, values FROM ("
          + _dv_sql("source") + ")")
def q_profile_column(spark, d):
    return PR.profile_column(fx.table(spark, d, "documents"), "source")


@register("label_counts_roundtrip", f"WITH dim AS ({DUCK_DATA_DIM}) SELECT task, count(*) AS num_labels FROM dim "
          "GROUP BY task")
def q_label_counts_roundtrip(spark, d):
    from corpuskit.operators.labels import label_counts
    path = scratch_dir(spark, "label-counts")
    io.write_label_counts(label_counts(_data_dimension(spark, d)), path)
    return io.read_label_counts(spark, path)


# -- training (rows-only: model fits are not SQL) ---------------------------

@register("train_multitask_eval", None)
def q_train_multitask_eval(spark, d):
    return TRN.evaluate_multitask(std(spark, d), num_features=4096)


@register("train_single_eval", None)
def q_train_single_eval(spark, d):
    s = std(spark, d).where(F.col("task_name") == "scotus")
    return TRN.evaluate_single(s, num_features=4096)


# -- streaming (rows-only) ----------------------------------------------------

@register("stream_documents", SQ._with(SQ._PROC_CTES) + SQ._record_sql())
def q_stream_documents(spark, d):
    from corpuskit.operators.labels import label_dimension
    schema = fx.table(spark, d, "documents").schema
    dim = label_dimension(fx.label_names_df(spark))
    sink = scratch_dir(spark, "stream-sink")
    ck = scratch_dir(spark, "stream-ckpt")
    ST.stream_documents(spark, d, schema, lambda s: process_document(s, "doc_id", "text", "scotus", dim, dict(fx.PLAIN_TERMS), **SQ._RECIPE), sink, ck)
    return spark.read.parquet(sink).withColumn("confidence", F.round("confidence", 6))


@register("incremental_standardize", fx.duck_with("v_scotus") +
          "SELECT doc_id, split, text AS input_text, label AS input_label, 'scotus' AS task_name FROM v_scotus")
def q_incremental_standardize(spark, d):
    schema = fx.table(spark, d, "documents").schema
    target = scratch_dir(spark, "std-target")
    ck = scratch_dir(spark, "std-ckpt")
    ST.incremental_standardize(spark, d, schema, fx.table(spark, d, "labels"), target, ck, fx.split_of())
    return ST.standardized_rows(spark, target)


@register("standardize_with_state", fx.duck_with("v_scotus") +
          "SELECT doc_id, split, text AS input_text, label AS input_label, 'scotus' AS task_name FROM v_scotus")
def q_standardize_with_state(spark, d):
    """T2 as one stateful stream of documents and labels."""
    docs, labels = (ST.document_stream(spark, d, fx.table(spark, d, t).schema, f"{t}.parquet") for t in ("documents", "labels"))
    target = scratch_dir(spark, "state-target")
    ST.standardize_with_state(docs, labels, target, scratch_dir(spark, "state-ckpt"), fx.split_of())
    return spark.read.parquet(target).select("doc_id", "split", "input_text", "input_label", "task_name")
