import pytest
from pyspark.sql import functions as F

from corpuskit.operators import metrics as M
from corpuskit.operators.scoring import softmax


def test_weighted_f1_golden(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label long, pred long")
    r = M.classification_metrics(df, None, "label", "pred").collect()[0]
    assert r.accuracy == pytest.approx(0.5)
    assert r.f1_weighted == pytest.approx(0.458333, abs=1e-6)


PAIR = [(1, 0, "the cat is on the mat", "the cat sat on the mat")]


def test_rouge_goldens(spark):
    df = spark.createDataFrame(PAIR, "conv_id long, turn long, pred string, ref string")
    r = {x.n: x.fmeasure for x in M.rouge_n(df, ["conv_id", "turn"], "pred", "ref", (1, 2)).collect()}
    assert r[1] == pytest.approx(0.833333, abs=1e-6)
    assert r[2] == pytest.approx(0.6, abs=1e-6)
    rl = M.rouge_l(df, ["conv_id", "turn"], "pred", "ref").collect()[0].fmeasure
    assert rl == pytest.approx(0.833333, abs=1e-6)


def test_bleu_golden(spark):
    df = spark.createDataFrame(PAIR, "conv_id long, turn long, pred string, ref string")
    b = M.bleu(df, ["conv_id", "turn"], "pred", "ref").collect()[0].bleu
    assert b == pytest.approx(0.254066, abs=1e-6)


def test_bleu_no_unigram_match_is_zero(spark):
    df = spark.createDataFrame([(1, 0, "x y z", "a b c")], "conv_id long, turn long, pred string, ref string")
    assert M.bleu(df, ["conv_id", "turn"], "pred", "ref").collect()[0].bleu == 0.0


def test_lcs_bit_parallel():
    assert M.lcs_length("a b c d e".split(), "a x c e".split()) == 3
    assert M.lcs_length([], ["a"]) == 0
    import random
    rnd = random.Random(1)
    for _ in range(50):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        assert M.lcs_length(a, b) == dp[-1][-1]


def test_generation_metrics_empty_is_zero(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, pred string, ref string")
    r = M.generation_metrics(df, ["conv_id", "turn"], "pred", "ref").collect()[0]
    assert (r.rouge1, r.rouge2, r.rougeL, r.gen_len, r.bleu, r.n_pairs) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_classification_metrics_empty_is_zero(spark):
    df = spark.createDataFrame([], "label long, pred long")
    assert tuple(M.classification_metrics(df, None).collect()[0]) == (0.0, 0.0, 0)


def test_generation_metrics_means_and_roundings(spark):
    rows = PAIR + [(2, 0, None, "a b"), (3, 0, "a b", None), (4, 0, "", ""), (5, 0, "x y z w v", "x y z w v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, pred string, ref string")
    ids = ["conv_id", "turn"]
    r = M.generation_metrics(df, ids, "pred", "ref", rouge_digits=None, bleu_digits=None).collect()[0]
    f = {n: [x.fmeasure for x in M.rouge_n(df, ids, "pred", "ref").where(f"n = {n}").collect()] for n in (1, 2)}
    lcs = M.rouge_l(df, ids, "pred", "ref").collect()
    bl = [x.bleu for x in M.bleu(df, ids, "pred", "ref").collect() if x.c > 0]
    assert r.rouge1 == pytest.approx(100 * sum(f[1]) / 5) and r.rouge2 == pytest.approx(100 * sum(f[2]) / 5)
    assert r.rougeL == pytest.approx(100 * sum(x.fmeasure for x in lcs) / 5) and {x.precision for x in lcs} >= {0.0, 1.0}
    assert r.bleu == pytest.approx(100 * sum(bl) / len(bl)) and r.gen_len == pytest.approx((6 + 2 + 5) / 5)
    rounded = M.generation_metrics(df, ids, "pred", "ref", rouge_digits=2, bleu_digits=2).collect()[0]
    assert rounded.rougeL == round(r.rougeL, 2)


def test_pair_scores_do_not_shuffle(spark):
    df = spark.createDataFrame(PAIR, "conv_id long, turn long, pred string, ref string")
    for out in (M.rouge_n(df, ["conv_id"], "pred", "ref"), M.rouge_l(df, ["conv_id"], "pred", "ref"), M.bleu(df, ["conv_id"], "pred", "ref")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_softmax_golden(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "l array<double>")
    p = df.select(softmax("l").alias("p")).collect()[0].p
    assert p == pytest.approx([0.090031, 0.244728, 0.665241], abs=1e-6)
    assert sum(p) == pytest.approx(1.0)


def _strip_s(t):
    return t[:-1] if t.endswith("s") else t


def test_stemmer_hook(spark):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(1, 0, "the cats sat", "the cat sat")], "conv_id long, turn long, pred string, ref string")
    plain = {x.n: x.fmeasure for x in M.rouge_n(df, ["conv_id", "turn"], "pred", "ref", (1,)).collect()}
    stem = {x.n: x.fmeasure for x in M.rouge_n(df, ["conv_id", "turn"], "pred", "ref", (1,), stemmer=_strip_s).collect()}
    assert plain[1] == pytest.approx(2 / 3) and stem[1] == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["rouge_stemmed", "evaluate_generation_stemmed"])
def test_stems_and_matches_in_one_worker(spark, name):
    """stems, matches and common subsequences of a pair come from one Python function."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
