from pyspark.sql import functions as F

from corpuskit.operators import splits as S
from corpuskit.plans import fixtures as fx
from corpuskit.plans.q_labels import std

SF = "/root/testdata/sf0.001"


def test_batches_task_pure_and_complete(spark):
    s = std(spark, SF, splits=["train"])
    b = S.task_batches(s, 16, 42)
    rows = b.collect()
    assert len(rows) == s.count()
    assert len({(r.doc_id, r.task_name) for r in rows}) == len(rows)
    per_batch = {}
    for r in rows:
        per_batch.setdefault(r.batch_id, set()).add(r.task_name)
    assert all(len(t) == 1 for t in per_batch.values())
    assert S.batch_coverage(s, b, ["doc_id", "task_name"]).count() == 0
    # positions are a permutation per task
    for t in {r.task_name for r in rows}:
        pos = sorted(r.pos_in_task for r in rows if r.task_name == t)
        assert pos == list(range(len(pos)))


def test_partitioning_invariance(spark):
    d = fx.documents(spark, SF)
    a = {(r.doc_id, r.split) for r in S.three_way_split(d.repartition(2), "doc_id").collect()}
    b = {(r.doc_id, r.split) for r in S.three_way_split(d.repartition(7), "doc_id").collect()}
    assert a == b
    s = std(spark, SF, splits=["train"])
    x = {(r.doc_id, r.task_name, r.batch_no) for r in S.task_batches(s.repartition(2), 8).collect()}
    y = {(r.doc_id, r.task_name, r.batch_no) for r in S.task_batches(s.repartition(7), 8).collect()}
    assert x == y


def test_splits_disjoint_and_complete(spark):
    d = fx.documents(spark, SF)
    out = S.three_way_split(d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert out.where("n <> 1").count() == 0
    assert out.count() == d.count()


def test_global_index_is_permutation(spark):
    s = std(spark, SF, splits=["train"])
    g = [r.global_idx for r in S.global_index(s).collect()]
    assert sorted(g) == list(range(len(g)))


def test_cap_rows(spark):
    d = fx.v_unfair(spark, SF)
    c = S.cap_rows(d, {"train": 10}, "doc_id")
    tr = sorted(r.doc_id for r in c.where("split = 'train'").collect())
    assert tr == sorted(r.doc_id for r in d.where("split = 'train'").orderBy("doc_id").limit(10).collect())
    assert c.where("split <> 'train'").count() == d.where("split <> 'train'").count()


def test_bucketed_rank_matches_row_number(spark):
    from pyspark.sql import Window
    s = std(spark, SF)
    a = {(r.doc_id, r.task_name): r.local_idx
         for r in S._local_index(s, "doc_id", "task_name", buckets=29).collect()}
    w = Window.partitionBy("task_name").orderBy("doc_id")
    b = {(r.doc_id, r.task_name): r.rn for r in s.select("doc_id", "task_name",
                                                          (F.row_number().over(w) - 1).alias("rn")).collect()}
    assert a == b
    h = s.groupBy("input_label").agg(F.count("*").alias("c"))
    cum = {r.input_label: r.start for r in S._local_index(h, "input_label", None, buckets=3,
                                                           out="start", weight="c").collect()}
    expect, acc = {}, 0
    for r in sorted(h.collect(), key=lambda r: r.input_label):
        expect[r.input_label] = acc
        acc += r.c
    assert cum == expect


def test_hash_split_ratios(spark):
    d = spark.range(100_000).withColumnRenamed("id", "doc_id")
    out = S.hash_split(d, "doc_id", {"train": 0.995, "test": 0.005}, seed=7)
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert 400 <= n["test"] <= 600 and n["train"] + n["test"] == 100_000
    assert {r.split for r in S.hash_split(d, "doc_id", {"all": 1.0}).select("split").distinct().collect()} == {"all"}


def test_many_splits_do_not_hide_one(spark):
    rows = [(i, f"s{i}") for i in range(300)] + [(900, "validation"), (901, "train")]
    d = spark.createDataFrame(rows, "doc_id long, split string")
    assert S.split_missing_validation(d, "doc_id").where("split = 'validation'").count() == 1
    from corpuskit.sources import io
    assert [r.doc_id for r in io.read_split(d, "s299").collect()] == [299]
    assert [r.doc_id for r in io.read_split(d, "dev").collect()] == [901]
    assert S.ensure_splits(d.unionByName(spark.createDataFrame([(902, "test")], d.schema)), "doc_id").where("split = 's1'").count() == 1


def test_first_rows_of_every_group(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "concat('g', id % 500) as g", "id % 7 as label")
    got = S.first_per_group(d, 2, "doc_id", "g").groupBy("g").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()
    assert len(got) == 500 and all(r.n == 2 and r.m == int(r.g[1:]) + 500 for r in got)


def test_an_outlier_does_not_fill_one_bucket(spark):
    d = spark.createDataFrame([(i,) for i in range(1000)] + [(10**15,), (None,)], "k long")
    sizes = {r._b: r["count"] for r in S.range_bucket(d, "k", "_b", 10).groupBy("_b").count().collect()}
    assert sizes[-1] == 1 and len(sizes) >= 10 and max(sizes.values()) <= 200
    got = [(r.k, r.local_idx) for r in S._local_index(d, "k", None, 10).collect()]
    assert sorted(got, key=lambda x: x[1]) == [(None, 0)] + [(i, i + 1) for i in range(1000)] + [(10**15, 1001)]


def test_ordered_index_of_strings(spark):
    names = ["", "a", "aa", "ab", "b", "é", "same prefix 1", "same prefix 2", "z" * 40, "ß"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in sorted(S.ordered_index(d, ["n"], buckets=4).collect(), key=lambda r: r.idx)]
    assert got == sorted(names, key=lambda n: n.encode())


def test_rows_without_a_task_have_a_global_index(spark):
    from corpuskit.operators import splits as S
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "doc_id long, task_name string")
    got = {r.doc_id: r.global_idx for r in S.global_index(df).collect()}
    assert sorted(got) == [1, 2, 3, 4] and sorted(got.values()) == [0, 1, 2, 3]


def test_keys_with_one_prefix_are_spread(spark):
    """String keys that begin alike fall into many partitions, and are numbered in order."""
    from pyspark.sql import functions as F

    from corpuskit.operators import splits as S
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = [f"https://x.org/{i:05d}" for i in range(1000)]
        df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string")
        out = S.ordered_index(df, ["k"])
        assert [r.k for r in out.orderBy("idx").collect()] == keys
        dealt = df.repartitionByRange(8, "k").groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) == 8 and max(r["count"] for r in dealt) < 300
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
