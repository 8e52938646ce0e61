import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.quality_rules import COUNTS, anomaly, features, fit_forest, good_documents, pick_threshold, quality_rules, text_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n", max_size=80)), max_size=6))
def test_counts_equal_plain_python(texts):
    assert [c[:5] for c in text_counts(texts)] == [plain_counts(t) for t in texts]


def test_forest_finds_what_is_far_off():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 4))
    x[:50] += 12
    s = anomaly(fit_forest(x, 60), x, len(x))
    assert s[:50].min() > np.quantile(s[50:], 0.98) and 0 < s.min() and s.max() <= 1
    assert (anomaly(fit_forest(x[:0], 10), x, 0) == 0).all()


def test_threshold_keeps_the_wanted_share():
    bins = [(10, 98, 0), (50, 1, 5), (60, 1, 20)]
    assert pick_threshold(bins, 100, 0.99) == 51 / 100 and pick_threshold([], 100, 0.99) == 2.0 and pick_threshold([(3, 5, 0)], 100, 0.9) == 2.0


def make(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    good = [" ".join(rng.choice(words, size=int(n))) + "\n" + " ".join(rng.choice(words, size=9)) for n in rng.integers(30, 200, size=300)]
    bad = ["*** ### ".join(rng.choice(words, size=60)) + "|||| " * 30 for _ in range(30)]
    odd = [None, "", "one two", "same five words over again " * 20, "x" * 100_000]
    df = documents(good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(300, 315)] + [(None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    return df, labels, good + bad + odd


def test_quality_rules(spark, documents):
    df, labels, texts = make(spark, documents)
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        plain = plain_counts(t)
        assert [got[i][c] for c in COUNTS] == plain
        assert got[i].base_failed == (plain[0] < 10 or 100 * plain[4] > 20 * plain[0])
        assert not (got[i].base_failed and got[i].kept)
    assert sum(got[i].kept for i in range(300)) >= 294 and sum(got[i].kept for i in range(300, 330)) <= 2
    kept = good_documents(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_repeated_rows_null_ids_no_labels_and_empty_tables(spark, documents):
    text = " ".join(f"w{i}" for i in range(40))
    df = documents([(1, text, "s"), (1, text, "s"), (None, text, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality_rules(df, none).collect()] == [True] * 3
    assert quality_rules(df.limit(0), none).count() == 0 and good_documents(df.limit(0), none).count() == 0


def test_held_out_rows_of_the_tables(spark):
    """Threshold from half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
