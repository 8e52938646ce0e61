"""SURVEY §5 (e): rank- and order-sensitive queries give the same result with 2
and 7 shuffle partitions."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["task_batches", "batch_order", "global_index", "cap_rows", "label_profile", "textrank_summary",
         "describe_columns", "label_dimension", "sample_label_range", "first_n", "split_missing_validation"]


def _rows(spark, name, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_on_2_and_7_partitions(spark, name):
    assert _rows(spark, name, 2) == _rows(spark, name, 7)
