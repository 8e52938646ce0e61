import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.importance import UNIT, _ngrams, kth_largest, log_ratio, resample

LABELS = "doc_id long, quality int, toxic int"


def make(spark, documents):
    random.seed(8)
    good = [" ".join(random.choices([f"law{i}" for i in range(60)], k=random.randint(20, 90))) for _ in range(240)]
    bad = [" ".join(random.choices([f"spam{i}" for i in range(60)], k=random.randint(20, 90))) for _ in range(40)]
    texts = good + bad + [None, "", " \n", "law1"]
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(i, 0, 0) for i in range(240, 280, 2)] + [(None, 1, 0), (241, None, None), (9999, 1, 0)]
    return documents(texts), spark.createDataFrame(labels, LABELS), texts


def test_weights_equal_plain_counts(spark, documents):
    """Log ratios from plain n-gram counts, with the buckets that the hashes give."""
    df, labels, texts = make(spark, documents)
    got = {r.doc_id: r for r in resample(df.repartition(3), labels).collect()}
    grams = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bucket, _ = _ngrams([t])
        assert len(bucket) == len(w) + max(0, len(w) - 1)
        grams[i] = Counter(bucket.tolist())
    raw, good = np.zeros(10_000), np.zeros(10_000)
    target = {r.doc_id for r in labels.where("quality = 1").where(F.xxhash64("doc_id", F.lit(18)) % 2 == 0).collect()}
    for i, c in grams.items():
        for b, n in c.items():
            raw[b] += n
            good[b] += n * (i in target)
    ratio = log_ratio(raw, good)
    assert good.sum() > 0
    for i, c in grams.items():
        n = sum(c.values())
        assert got[i].n_ngrams == n
        assert got[i].log_weight is None if n == 0 else math.isclose(got[i].log_weight, UNIT * sum(ratio[b] * k for b, k in c.items()) / n, rel_tol=1e-9, abs_tol=1e-9)


def test_good_text_is_drawn(spark, documents):
    df, labels, texts = make(spark, documents)
    got = {r.doc_id: r for r in resample(df, labels).collect()}
    assert len(got) == len(texts) and not any(got[i].kept for i in (280, 281, 282))
    assert sum(got[i].kept for i in range(1, 240, 2)) >= 110 and sum(got[i].kept for i in range(241, 280, 2)) <= 1
    half = [r for r in resample(df, labels, share=0.5).collect() if r.kept]
    assert len(half) == round(0.5 * 281) and all(r.doc_id < 240 or r.doc_id == 283 for r in half)


def test_noise_follows_the_gumbel_distribution(spark, documents):
    rows = resample(documents([f"w{i}" for i in range(3000)]), spark.createDataFrame([], LABELS)).collect()
    noise = np.sort([r.drawn - r.log_weight for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.1
    assert all(r.kept for r in rows)


def test_repeated_rows_null_ids_and_empty_tables(spark, documents):
    none = spark.createDataFrame([], LABELS)
    df = documents([(1, "a b", "s"), (1, "a b", "s"), (None, "a b", None)])
    rows = resample(df, none).collect()
    assert [r.kept for r in rows] == [True] * 3 and len({r.drawn for r in rows if r.doc_id == 1}) == 1
    assert resample(df.limit(0), none).count() == 0


@pytest.mark.parametrize("bins", [4, 4096])
def test_kth_largest(spark, bins):
    x = np.random.default_rng(1).normal(size=700).tolist() + [1.0] * 50 + [None] * 3 + [1e300, -1e300, 5e-324, 0.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").cache()
    y = sorted((v for v in x if v is not None), reverse=True)
    for k in (1, 2, 7, 140, 160, 400, len(y) - 1, len(y)):
        assert kth_largest(df, "x", k, bins=bins) == y[k - 1]
    assert kth_largest(df, "x", 0) == math.inf


def test_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = resample(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
