"""SARI, meaning, readability and user metrics against plain versions."""

import math
import pickle

import pytest

from corpuskit.operators import simplification as S
from corpuskit.operators.callback import evaluate_with
from corpuskit.operators.metrics import classification_metrics


def test_sari_of_known_cases(spark):
    src, good, ref = "about 95 species are currently accepted", "about 95 species are now accepted", ["about 95 species are now accepted"]
    rows = [(0, src, good, ref), (1, src, src, [src]), (2, src, src, ref), (3, src, "zebra", ref), (4, src, good, []), (5, src, good, None), (6, None, None, [""]), (7, src, good, [src, good])]
    got = {r.id: r.sari for r in S.sari(spark.createDataFrame(rows, "id int, s string, o string, r array<string>"), "s", "o", "r").collect()}
    assert got[0] == pytest.approx(100) and got[1] == pytest.approx(100) and got[6] == pytest.approx(100)
    assert got[3] < got[2] < got[0] and got[4] is None and got[5] is None
    assert got[2] < got[7] < 100  # what half of the references keep is only half kept


def test_meaning_follows_rare_terms(spark):
    rows = [(i, "the court of the state decided", "the court of the state decided") for i in range(20)]
    rows += [(50, "the habeas petition", "the petition"), (51, "the habeas petition", "the habeas"), (52, "the the", "of of"), (53, None, "x y"), (54, "", "")]
    got = {r.id: r.meaning for r in S.meaning_preservation(spark.createDataFrame(rows, "id long, a string, b string"), ["id"], "a", "b").collect()}
    assert len(got) == 25 and got[0] == pytest.approx(1) and got[52] == got[53] == got[54] == 0
    df = {"the": 46 - 1, "habeas": 3, "petition": 3}  # texts that hold the term, of 50
    idf = {t: math.log(51 / (1 + d)) + 1 for t, d in {"the": 20 * 2 + 4 + 1, "habeas": 3, "petition": 3}.items()}
    assert df["the"] == 45
    plain = (idf["the"] ** 2 + idf["petition"] ** 2) / math.sqrt((idf["the"] ** 2 + idf["habeas"] ** 2 + idf["petition"] ** 2) * (idf["the"] ** 2 + idf["petition"] ** 2))
    assert got[50] == pytest.approx(plain)


def test_syllables_and_figures(spark):
    words = {"cat": 1, "table": 2, "make": 1, "the": 1, "contract": 2, "agreement": 3, "judge": 1, "psst": 1, "reasonable": 4, "be": 1, "été": 2}
    df = spark.createDataFrame([(w, w) for w in words], "w string, text string")
    assert {r.w: r.n_syllables for r in S.readability_counts(df).collect()} == words
    rows = [(0, "The cat sat. The dog ran! Why?"), (1, None), (2, "12 34."), (3, "word " * 100_000)]
    got = {r.id: r for r in S.readability(spark.createDataFrame(rows, "id int, text string")).collect()}
    r = got[0]
    assert (r.n_sentences, r.n_words, r.n_syllables) == (3, 7, 7) and r.reading_ease == pytest.approx(206.835 - 1.015 * 7 / 3 - 84.6)
    assert got[1].reading_ease is None and got[2].n_words == 0 and got[2].grade is None and got[3].n_words == 100_000
    by = S.readability(spark.createDataFrame([("a", "One two."), ("a", "Three."), ("b", None)], "g string, text string"), "text", ["g"]).collect()
    assert {r.g: (r.n_texts, r.n_sentences, r.n_words) for r in by} == {"a": (2, 2, 3), "b": (1, 0, 0)}


@pytest.mark.parametrize("fan_in", [2, 32])
def test_user_metric_equals_the_library_figure(spark, fan_in):
    def count(table):
        return [(table.num_rows, sum(a == b for a, b in zip(table["label"].to_pylist(), table["pred"].to_pylist())))]

    def share(state):
        n, hits = sum(x for x, _ in state), sum(y for _, y in state)
        return {"accuracy": hits / n, "n": n, "none": None}

    def join(a, b):
        return a + b

    rows = [(["a", "b", None][i % 3], i % 4, i * 7 % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "task string, label long, pred long").repartition(11)
    got = {r.task: (r.accuracy, r.n, r.none) for r in evaluate_with(df, ["label", "pred"], count, join, share, ["accuracy", "n", "none"], "task", fan_in).collect()}
    plain = {r.task: (r.accuracy, float(r.n), None) for r in classification_metrics(df, "task").collect()}
    assert got == plain and len(got) == 3
    one = evaluate_with(df, ["label", "pred"], count, join, share, ["accuracy", "n"], None, fan_in).collect()
    assert len(one) == 1 and one[0].n == 500 and one[0].accuracy == pytest.approx(classification_metrics(df, None).first().accuracy)
    assert evaluate_with(df.limit(0), ["label", "pred"], count, join, share, ["n"], "task").count() == 0


def test_states_are_merged_in_a_tree(spark):
    """No task merges more than fan_in states of a group a level."""
    df = spark.createDataFrame([(i, i) for i in range(64)], "label long, pred long").repartition(16)

    def depth(state):
        return {"depth": state["depth"], "rows": state["rows"]}
    r = evaluate_with(df, ["label", "pred"], lambda t: {"depth": 0, "rows": t.num_rows, "states": 1},
                      lambda a, b: {"depth": max(a["depth"], b["depth"]) + 1, "rows": a["rows"] + b["rows"], "states": 0}, depth, ["depth", "rows"], None, 2).first()
    assert r.rows == 64 and r.depth < 15 and pickle.loads(pickle.dumps(r.rows)) == 64
