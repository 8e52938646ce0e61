from pyspark.sql import functions as F

from corpuskit.operators import labels as L
from corpuskit.operators.scoring import argmax


def test_multi_label_rule(spark):
    # FIXTURES C: [] -> 0, null -> 0, [3,1] -> 3, [7] -> 7, [8] -> 0, [9,2] -> 0, [-1,2] -> 0
    rows = [(0, []), (1, None), (2, [3, 1]), (3, [7]), (4, [8]), (5, [9, 2]), (6, [-1, 2])]
    df = spark.createDataFrame(rows, "doc_id long, labels array<bigint>").withColumn("text", F.lit("t"))
    got = {r.doc_id: r.input_label for r in L.standardize_multi_label(df, "unfair_tos", 8).collect()}
    assert got == {0: 0, 1: 0, 2: 3, 3: 7, 4: 0, 5: 0, 6: 0}


def test_encode_label(spark):
    # names 0..4: '3'->3, ' 2 '->2, null->-1, '7'->-1, 'x'->-1, '-1'->-1
    rows = [(0, "3"), (1, " 2 "), (2, None), (3, "7"), (4, "x"), (5, "-1")]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r.id: r.v for r in df.select("id", L.encode_label("raw", ["0", "1", "2", "3", "4"]).alias("v")).collect()}
    assert got == {0: 3, 1: 2, 2: -1, 3: -1, 4: -1, 5: -1}


def test_label_name_fallbacks(spark):
    names = spark.createDataFrame([("a", ["zero", "one"]), ("c", [])], "task string, names array<string>")
    dim = L.label_dimension(names)
    req = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "b", 9), (4, "c", 0)],
                                "id int, task string, label_id bigint")
    got = {r.id: r.label_name for r in L.attach_label_names(req, dim).collect()}
    assert got == {1: "one", 2: "ID_9_NotInMap", 3: "ID_9_NoMapForTask", 4: "ID_0_NoMapForTask"}


def test_quarantine_row_and_batch(spark):
    counts = spark.createDataFrame([("t", 3)], "task string, num_labels bigint")
    df = spark.createDataFrame([(1, "t", 0, "b1"), (2, "t", 5, "b1"), (3, "t", 2, "b2"), (4, "u", 0, "b2")],
                               "doc_id long, task_name string, input_label bigint, batch_id string")
    ok, bad = L.quarantine_labels(df, counts)
    assert sorted(r.doc_id for r in ok.collect()) == [1, 3]
    assert sorted(r.doc_id for r in bad.collect()) == [2, 4]
    ok_b, bad_b = L.quarantine_labels(df, counts, level="batch")
    assert sorted(r.doc_id for r in ok_b.collect()) == []
    assert sorted(r.doc_id for r in bad_b.collect()) == [1, 2, 3, 4]


def test_label_profile_first_appearance_cap(spark):
    rows = [(i, "t", (60 - i) % 60) for i in range(60)] + [(100, "s", -1)]
    df = spark.createDataFrame(rows, "doc_id long, task_name string, input_label bigint")
    prof = {r.task_name: r for r in L.label_profile(df, expected_max={"t": 59, "s": 3}, list_cap=50).collect()}
    t = prof["t"]
    assert (t.min_label, t.max_label, t.num_unique, t.verdict) == (0, 59, 60, "in_range")
    # first 50 labels by first appearance: 0, 59, 58, ..., 11 -> sorted
    assert t.unique_labels == ",".join(str(x) for x in sorted([0] + list(range(11, 60))))
    assert prof["s"].verdict == "out_of_range"


def test_argmax_first_index(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.7, 0.7],)], "p array<double>")
    assert [r.a for r in df.select(argmax("p").alias("a")).collect()] == [0, 1]


def test_task_without_one_count_is_an_error(spark):
    import pytest
    from corpuskit.operators import labels as L
    df = spark.createDataFrame([("a",), ("b",)], "task_name string")
    counts = spark.createDataFrame([("a", 2), ("b", 3)], "task string, num_labels long")
    L.check_task_counts(df, counts)
    for bad in (counts.where("task = 'a'"), counts.unionByName(counts.where("task = 'b'"))):
        with pytest.raises(ValueError, match="1 task.*: b"):
            L.check_task_counts(df, bad)


def test_unsupported_task_lists_all(spark):
    from corpuskit.operators import labels as L
    names = spark.range(1500).selectExpr("concat('t', lpad(cast(id as string), 4, '0')) as task")
    got = L.unsupported_task(spark.createDataFrame([("x",), ("t0001",)], "task string"), names).collect()
    err = {r.task: r.error for r in got}
    assert err["t0001"] is None and err["x"].endswith("t1499]") and err["x"].count(",") == 1499
