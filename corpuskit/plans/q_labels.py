"""Catalog entries for label standardization, encoding, validation and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import labels as L
from corpuskit.operators.scoring import argmax
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import duck_task_counts, register, task_counts_df

CASEHOLD_NAMES = ["0", "1", "2", "3", "4"]


def std(spark, d, splits=None):
    """The standardized multi-task table: scotus, ledgar, unfair_tos."""
    s = L.standardize_corpora({"scotus": fx.v_scotus(spark, d), "ledgar": fx.v_ledgar(spark, d),
                               "unfair_tos": fx.v_unfair(spark, d)})
    return s if splits is None else s.where(F.col("split").isin(*splits))


def casehold_std(spark, d):
    c = fx.v_casehold(spark, d)
    return L.cast_to_standard(c.select("doc_id", "split", F.col("text").alias("input_text"),
                                       L.encode_label("label", CASEHOLD_NAMES).alias("input_label"),
                                       F.lit("casehold").alias("task_name")))


def std4(spark, d):
    return std(spark, d).unionByName(casehold_std(spark, d))


# DuckDB twins -------------------------------------------------------------

DUCK_STD = ("SELECT doc_id, split, text AS input_text, label AS input_label, 'scotus' AS task_name FROM v_scotus "
            "UNION ALL SELECT doc_id, split, text, label, 'ledgar' FROM v_ledgar "
            "UNION ALL SELECT doc_id, split, text, CASE WHEN labels[1] BETWEEN 0 AND 7 THEN labels[1] ELSE 0 END, "
            "'unfair_tos' FROM v_unfair")


def duck_encode(raw: str, names=CASEHOLD_NAMES) -> str:
    m = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    n = len(names)
    return (f"(CASE WHEN {raw} IS NULL THEN -1 ELSE coalesce(CASE {raw} {m} END, CASE trim({raw}) {m} END, "
            f"CASE WHEN TRY_CAST(trim({raw}) AS BIGINT) BETWEEN 0 AND {n - 1} THEN TRY_CAST(trim({raw}) AS BIGINT) END, "
            f"-1) END)::BIGINT")


DUCK_CASEHOLD_STD = (f"SELECT doc_id, split, text AS input_text, {duck_encode('label')} AS input_label, "
                     "'casehold' AS task_name FROM v_casehold")
DUCK_STD4 = f"SELECT * FROM std UNION ALL SELECT * FROM casehold_std"


def with_std(*extra_views, std4_needed=False, extra=None):
    views = ["v_scotus", "v_ledgar", "v_unfair"] + (["v_casehold"] if std4_needed else []) + list(extra_views)
    ctes = {"std": DUCK_STD}
    if std4_needed:
        ctes["casehold_std"] = DUCK_CASEHOLD_STD
        ctes["std4"] = DUCK_STD4
    ctes.update(extra or {})
    return fx.duck_with(*views, extra=ctes)


# Queries ------------------------------------------------------------------

@register("std_single_label", fx.duck_with("v_scotus") +
          "SELECT doc_id, split, text AS input_text, label AS input_label, 'scotus' AS task_name FROM v_scotus")
def q_std_single_label(spark, d):
    return L.standardize_single_label(fx.v_scotus(spark, d), "scotus")


@register("std_multi_label", fx.duck_with("v_unfair") +
          "SELECT doc_id, split, text AS input_text, "
          "(CASE WHEN labels[1] BETWEEN 0 AND 7 THEN labels[1] ELSE 0 END)::BIGINT AS input_label, "
          "'unfair_tos' AS task_name, coalesce(len(labels) <= 0, true) AS label_missing FROM v_unfair")
def q_std_multi_label(spark, d):
    return L.standardize_multi_label(fx.v_unfair(spark, d), "unfair_tos", 8, flag_missing=True)


@register("std_cast", fx.duck_with("v_casehold", extra={"casehold_std": DUCK_CASEHOLD_STD}) +
          "SELECT * FROM casehold_std")
def q_std_cast(spark, d):
    return casehold_std(spark, d)


@register("encode_label", fx.duck_with("v_casehold") +
          f"SELECT doc_id, label, {duck_encode('label')} AS safe_label FROM v_casehold")
def q_encode_label(spark, d):
    c = fx.v_casehold(spark, d)
    return c.select("doc_id", "label", L.encode_label("label", CASEHOLD_NAMES).alias("safe_label"))


@register("std_union", with_std() + "SELECT * FROM std WHERE split = 'train'")
def q_std_union(spark, d):
    return std(spark, d, splits=["train"])


@register("standardize_corpora", with_std() +
          "SELECT task_name, split, count(*) AS n_rows, sum(input_label)::BIGINT AS label_sum FROM std GROUP BY ALL")
def q_standardize_corpora(spark, d):
    """C1 end to end: standardized union, summarised per task and split."""
    return std(spark, d).groupBy("task_name", "split").agg(
        F.count("*").alias("n_rows"), F.sum("input_label").alias("label_sum"))


def _data_dimension(spark, d):
    docs = fx.table(spark, d, "documents")
    return L.class_encode(docs, "lang").unionByName(L.class_encode(docs, "source"))


DUCK_DATA_DIM = ("SELECT 'lang' AS task, (row_number() OVER (ORDER BY label_name) - 1)::BIGINT AS label_id, label_name "
                 "FROM (SELECT DISTINCT lang::VARCHAR AS label_name FROM documents WHERE lang IS NOT NULL) "
                 "UNION ALL SELECT 'source', (row_number() OVER (ORDER BY label_name) - 1)::BIGINT, label_name "
                 "FROM (SELECT DISTINCT source::VARCHAR AS label_name FROM documents WHERE source IS NOT NULL)")


@register("label_dimension", f"WITH dim AS ({DUCK_DATA_DIM}) SELECT * FROM dim")
def q_label_dimension(spark, d):
    return _data_dimension(spark, d)


@register("label_counts", f"WITH dim AS ({DUCK_DATA_DIM}) SELECT task, count(*) AS num_labels FROM dim GROUP BY task")
def q_label_counts(spark, d):
    return L.label_counts(_data_dimension(spark, d))


_PROFILE_SQL = """, pl AS (SELECT task_name, input_label, min(doc_id) AS first_id FROM std4 WHERE split = 'train' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY first_id, input_label) AS ord FROM pl),
pr AS (SELECT task_name, min(input_label) AS min_label, max(input_label) AS max_label, count(*) AS num_unique,
       array_to_string(list_sort(list(input_label) FILTER (WHERE ord <= 50)), ',') AS unique_labels FROM rk GROUP BY task_name),
em AS (SELECT * FROM (VALUES ('casehold', 4), ('unfair_tos', 7), ('scotus', 12), ('ledgar', 99)) AS t(task, mx))
SELECT task_name, min_label, max_label, num_unique, unique_labels,
  CASE WHEN em.mx IS NULL THEN 'unknown' WHEN min_label < 0 OR max_label > em.mx THEN 'out_of_range' ELSE 'in_range' END AS verdict
FROM pr LEFT JOIN em ON em.task = pr.task_name"""


@register("label_profile", with_std(std4_needed=True).rstrip("\n") + _PROFILE_SQL)
def q_label_profile(spark, d):
    return L.label_profile(std4(spark, d).where(F.col("split") == "train"))


@register("validate_labels", with_std(std4_needed=True).rstrip("\n") + _PROFILE_SQL.replace(
    "WHERE split = 'train' ", ""))
def q_validate_labels(spark, d):
    """The profile over every split of every standardized task (one job)."""
    return L.label_profile(std4(spark, d))


@register("label_out_of_range", with_std(std4_needed=True) +
          "SELECT DISTINCT s.task_name, s.input_label FROM std4 s JOIN (VALUES ('casehold', 4), ('unfair_tos', 7), "
          "('scotus', 12), ('ledgar', 99)) AS em(task, mx) ON em.task = s.task_name "
          "WHERE NOT (s.input_label BETWEEN 0 AND em.mx)")
def q_label_out_of_range(spark, d):
    return L.out_of_range_labels(std4(spark, d))


@register("distinct_labels", with_std(std4_needed=True) + "SELECT DISTINCT task_name, input_label FROM std4")
def q_distinct_labels(spark, d):
    return std4(spark, d).select("task_name", "input_label").distinct()


@register("valid_label_quarantine", with_std(std4_needed=True, extra={"counts": duck_task_counts()}) +
          "SELECT s.doc_id, s.task_name, s.input_label, coalesce(s.input_label >= 0 AND s.input_label < c.num_labels, "
          "false) AS is_valid FROM std4 s LEFT JOIN counts c ON c.task = s.task_name")
def q_valid_label_quarantine(spark, d):
    return L.label_validity(std4(spark, d), task_counts_df(spark)).select("doc_id", "task_name", "input_label", "is_valid")


@register("valid_label_batches", with_std(std4_needed=True, extra={"counts": duck_task_counts()}) +
          "SELECT s.doc_id, s.task_name, s.input_label, bool_and(coalesce(s.input_label >= 0 AND s.input_label < c.num_labels, false)) "
          "OVER (PARTITION BY s.doc_id // 16) AS is_valid FROM std4 s LEFT JOIN counts c ON c.task = s.task_name")
def q_valid_label_batches(spark, d):
    """P11 at batch level: one bad label refuses its whole batch (16 documents here)."""
    rows = std4(spark, d).withColumn("batch_id", F.floor(F.col("doc_id") / 16))
    return L.label_validity(rows, task_counts_df(spark), "batch").select("doc_id", "task_name", "input_label", "is_valid")


_SUBSET_COUNTS = {"scotus": 2, "ledgar": 2, "unfair_tos": 8, "eurlex": 100}


@register("task_subset", with_std(std4_needed=True, extra={"counts": duck_task_counts(_SUBSET_COUNTS)}) +
          "SELECT doc_id, task_name, input_label FROM std4 WHERE task_name IN (SELECT task FROM counts)")
def q_task_subset(spark, d):
    return L.task_subset(std4(spark, d), task_counts_df(spark, _SUBSET_COUNTS)).select(
        "doc_id", "task_name", "input_label")


@register("task_mismatch", with_std(std4_needed=True, extra={"counts": duck_task_counts(_SUBSET_COUNTS)}) +
          "SELECT task, 'loaded_without_count' AS side FROM (SELECT DISTINCT task_name AS task FROM std4) "
          "WHERE task NOT IN (SELECT task FROM counts) UNION ALL "
          "SELECT task, 'count_without_data' FROM counts WHERE task NOT IN (SELECT DISTINCT task_name FROM std4)")
def q_task_mismatch(spark, d):
    loaded = std4(spark, d).select(F.col("task_name").alias("task"))
    return L.task_mismatch(loaded, task_counts_df(spark, _SUBSET_COUNTS))


_REQ_TASKS = ["scotus", "ledgar", "unfair_tos", "casehold", "eurlex"]


@register("unsupported_task", with_std(std4_needed=True) +
          "SELECT doc_id, ['scotus','ledgar','unfair_tos','casehold','eurlex'][doc_id % 5 + 1] AS task, "
          "CASE WHEN doc_id % 5 = 4 THEN 'Task ''eurlex'' not supported. Supported tasks: "
          "[casehold, ledgar, scotus, unfair_tos]' END AS error FROM documents")
def q_unsupported_task(spark, d):
    req = fx.documents(spark, d).select(
        "doc_id", F.element_at(F.array(*[F.lit(t) for t in _REQ_TASKS]),
                               (F.col("doc_id") % 5 + 1).cast("int")).alias("task"))
    supported = std4(spark, d).select(F.col("task_name").alias("task"))
    return L.unsupported_task(req, supported).select("doc_id", "task", "error")


_LOOKUP_TASKS = ["scotus", "unfair_tos", "ledgar"]


@register("label_name_lookup", fx.duck_with("v_logits", extra={"dim": fx.duck_label_dim_values()}) +
          """, p AS (SELECT vec_id, ['scotus','unfair_tos','ledgar'][vec_id % 3 + 1] AS task,
   (list_position(logits, list_max(logits)) - 1)::BIGINT AS label_id FROM v_logits)
SELECT p.vec_id, p.task, p.label_id, CASE WHEN dim.label_name IS NOT NULL THEN dim.label_name
  WHEN p.task IN (SELECT task FROM dim) THEN 'ID_' || p.label_id::VARCHAR || '_NotInMap'
  ELSE 'ID_' || p.label_id::VARCHAR || '_NoMapForTask' END AS label_name
FROM p LEFT JOIN dim ON dim.task = p.task AND dim.label_id = p.label_id""")
def q_label_name_lookup(spark, d):
    lg = fx.v_logits(spark, d)
    p = lg.select("vec_id", F.element_at(F.array(*[F.lit(t) for t in _LOOKUP_TASKS]),
                                         (F.col("vec_id") % 3 + 1).cast("int")).alias("task"),
                  argmax("logits").alias("label_id"))
    dim = L.label_dimension(fx.label_names_df(spark))
    return L.attach_label_names(p, dim, task="task", label="label_id").select(
        "vec_id", "task", "label_id", "label_name")


@register("label_name_unknown", fx.duck_with("v_logits") +
          """, p AS (SELECT vec_id, ['scotus','unfair_tos','ledgar'][vec_id % 3 + 1] AS task,
   (list_position(logits, list_max(logits)) - 1)::BIGINT AS label_id FROM v_logits)
SELECT p.vec_id, p.task, p.label_id, CASE WHEN label_id < CASE task WHEN 'unfair_tos' THEN 8 ELSE 2 END THEN task || '_label_' || label_id::VARCHAR
  ELSE 'Unknown Label (' || label_id::VARCHAR || ')' END AS label_name FROM p""")
def q_label_name_unknown(spark, d):
    """Numbered names for tasks without a name list, one text for unknown ids."""
    p = fx.v_logits(spark, d).select("vec_id", F.element_at(F.array(*[F.lit(t) for t in _LOOKUP_TASKS]), (F.col("vec_id") % 3 + 1).cast("int")).alias("task"),
                                     argmax("logits").alias("label_id"))
    return L.attach_label_names(p, L.numbered_labels(task_counts_df(spark)), unknown="Unknown Label ({id})").select("vec_id", "task", "label_id", "label_name")
