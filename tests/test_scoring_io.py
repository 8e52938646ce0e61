import os
import tempfile

import pytest

from pyspark.sql import functions as F

from corpuskit.operators import scoring as SC
from corpuskit.operators import profile as PR
from corpuskit.sources import io
from corpuskit.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_score_with_model_fallback_and_total_failure(spark):
    # factories must be importable on the workers: use the catalog's stand-ins
    from corpuskit.plans.q_scoring import _broken_model, _keyword_model
    df = spark.createDataFrame([(1, "Ab cd"), (2, "ab cd")], "id long, t string")
    r = SC.score_with_model(df, [_broken_model, _keyword_model], "t", "o", "double", keep=["id"]).collect()
    assert {(x.id, x.o, x.backend) for x in r} == {(1, 0.5, "fallback_1"), (2, 0.0, "fallback_1")}
    r = SC.score_with_model(df, [_broken_model], "t", "o", sentinel=SC.SUMMARY_ERROR, keep=["id"]).collect()
    assert all(x.o == SC.SUMMARY_ERROR and x.error.startswith("RuntimeError") for x in r)


def _odd_model():
    def score(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return texts.map(len)
    return score


def _len_model():
    return lambda texts: texts.map(lambda t: -len(t))


def _short_model():
    return lambda texts: texts.iloc[:1].map(len)


def test_each_row_falls_back_on_its_own(spark):
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(10)], "id long, t string").coalesce(1)
    for batch in (None, 2):
        r = {x.id: (x.o, x.backend, x.error) for x in SC.score_with_model(df, [_odd_model, _len_model], "t", "o", "long", keep=["id"], batch_rows=batch).collect()}
        assert r[3] == (-3, "fallback_1", None) and all(r[i] == (i, "primary", None) for i in r if i != 3)
    r = {x.id: (x.o, x.error) for x in SC.score_with_model(df, [_odd_model], "t", "o", "long", sentinel=-1, keep=["id"]).collect()}
    assert r[3] == (-1, "ValueError: bad text") and r[4] == (4, None)
    # a result of the wrong length is a failure of the batch, not of the job
    r = SC.score_with_model(df, [_short_model], "t", "o", "long", keep=["id"]).collect()
    assert sorted(x.o for x in r) == sorted(len(x.t) for x in df.collect())


def test_pipeline_record(spark):
    long = " ".join(f"Alpha beta gamma delta epsilon zeta {i}." for i in range(9))
    df = spark.createDataFrame([(1, "Alpha beta gamma. 12 delta."), (2, None), (3, long)], "doc_id long, text string")
    r = {x.doc_id: x for x in SC.process_document(df, terms={"alpha": "first"}).collect()}
    assert "trimmed" in r[1].summary and r[1].task == "scotus" and 0.5 <= r[1].confidence <= 1.0
    assert set(r) == {1, 2, 3} and r[3].error is None and "first" in r[3].simplified_summary and r[3].summary_words >= 35
    try:
        SC.process_document(df)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_report_of_a_failed_classification(spark):
    df = spark.createDataFrame([(None, None, "s", "t")], "predicted_label_name string, confidence double, summary string, simplified_summary string")
    got = df.select(SC.report_text(df).alias("r")).first().r.split("\n")
    assert got == [SC.REPORT_TITLE, "", "CLASSIFICATION: Error", "Confidence: 0.0000", "", "SUMMARY:", "s", "", "SIMPLIFIED SUMMARY:", "t"]


def test_dictionary_paths_agree_on_repeated_terms(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cat the dog")], "doc_id long, text string")
    terms = spark.createDataFrame([("the", "B"), ("the", "A"), (None, "x")], "term string, plain string")
    for bound in (10_000, 0):
        monkeypatch.setattr(SC, "INLINE_TERMS_MAX", bound)
        assert SC.dictionary_simplify(df, "doc_id", "text", terms).first().simplified == "A cat A dog"


def test_dictionary_paths_agree_on_many_terms_and_repeated_ids(spark, monkeypatch):
    words = {f"t{i}": f"p{i}" for i in range(3000)} | {"Stra\u00dfe": "never", "stra\u00dfe": "road", 'a"b\\': "quoted", "": "none"}
    rows = [(1, "T1 x  t2999 t3000"), (1, "t2 t1"), (1, "t2 t1"), (None, "STRA\u00dfE y"), (None, 'A"B\\ t7'), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame(list(words.items()), "term string, plain string")
    want = sorted(" ".join(words.get(w.lower(), w) for w in t.split()) if t and t.strip() else words[""] if t == "" else "" for _, t in rows)
    got = {}
    for bound in (10_000, 0):
        monkeypatch.setattr(SC, "INLINE_TERMS_MAX", bound)
        r = SC.dictionary_simplify(df, "doc_id", "text", terms)
        assert r.columns == ["doc_id", "text", "simplified"]
        got[bound] = sorted((str(x.doc_id), str(x.text), x.simplified) for x in r.collect())
    assert got[10_000] == got[0] and len(got[0]) == len(rows)
    assert sorted(x[2] for x in got[0]) == want


def test_profile_edges(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    assert tuple(PR.distinct_values(df, "c").first()) == ("c", 3, "a|b|None")
    rows = {(r.c, r.n_rows, r.is_total) for r in PR.rows_per_split(df, "c").collect()}
    assert rows == {("a", 1, False), ("b", 1, False), (None, 1, False), (None, 3, True)}


def test_unicode_spaces_part_words(spark):
    from corpuskit.functions import text as X
    df = spark.createDataFrame([("one\u00a0two\u2003three\x85",)], "t string")
    assert tuple(df.select(X.word_count("t"), X.clean_text("t"), F.size(X.words("t"))).first()) == (3, "one two three", 3)


def test_pairs_csv_tsv_fallback(spark):
    d = tempfile.mkdtemp(prefix="pairs-", dir="/tmp")
    p = os.path.join(d, "p.tsv")
    with open(p, "w") as f:
        f.write("a\tb\nhard words\teasy\n")
    got = io.read_pairs_csv(spark, p).collect()
    assert [(r.complex, r.simple) for r in got] == [("hard words", "easy")]


def test_pick_and_require_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id long, opinion_text string, syllabus string")
    assert io.pick_column(df, None, io.TEXT_HINTS_ABSTRACTIVE) == "opinion_text"
    assert io.pick_column(df, "syllabus", io.SUMMARY_HINTS) == "syllabus"
    try:
        io.require_columns(df, ["missing"])
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_quantiles_match_numpy(spark):
    import numpy as np
    vals = [1, 1, 1, 2, 5, 5, 9, 12, 12, 40]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    q = {r.p: r.q for r in PR.exact_quantiles(df, "x").collect()}
    for p in (0.25, 0.5, 0.75):
        assert abs(q[p] - float(np.quantile(vals, p))) < 1e-9


def test_fallback_prefix_for_labels(spark):
    from corpuskit.plans.q_scoring import _broken_model, _label_model

    df = spark.createDataFrame([(1, "Ab cd")], "id long, t string")
    r = SC.score_with_model(df, [_broken_model, _label_model], "t", "label", keep=["id"],
                            fallback_prefix=SC.FALLBACK_PREFIX).collect()[0]
    assert (r.label, r.backend, r.error) == ("FALLBACK_LABEL_0", "fallback_1", None)
    r = SC.score_with_model(df, [_label_model], "t", "label", keep=["id"],
                            fallback_prefix=SC.FALLBACK_PREFIX).collect()[0]
    assert (r.label, r.backend) == ("LABEL_0", "primary")


@pytest.mark.parametrize("name", ["report_text_failures", "process_document_failures", "process_document_models"])
def test_models_get_one_column_and_two_workers(spark, name):
    """only what a model reads goes to Python, and the two models that read the text share a worker."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 2
