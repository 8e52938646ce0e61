import pytest
from pyspark.sql import functions as F

from corpuskit.operators import textrank as TR
from corpuskit.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def _summ(spark, rows, k=2, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.summary for r in TR.textrank_summarize(df, num_sentences=k, **kw).collect()}


def test_edge_rules(spark):
    long_a = "alpha beta gamma delta epsilon zeta."
    long_b = "eta theta iota kappa lambda mu."
    rows = [
        (1, "short one. tiny two."),                              # no sentence of >= 6 words
        (2, long_a),                                              # fewer than k
        (3, "the a an of to in. and or but if of the."),          # stop words only (with English list)
    ]
    got = _summ(spark, rows, k=2, stop_words=None)
    assert got[1] == "short one. tiny two." + "... (trimmed)"
    assert got[2] == long_a
    # every sentence is stop words only: empty vocabulary -> first k in order
    got_sw = _summ(spark, [(3, "the a an of to in. and or but if of the. it is was be to of.")], k=2)
    assert got_sw[3] == "the a an of to in. and or but if of the."
    # one informative sentence outranks the stop-word ones; output stays in document order
    got_mix = _summ(spark, [(4, "the a an of to in. and or but if of the. " + long_b)], k=2)
    assert got_mix[4] == "the a an of to in. " + long_b


def test_scores_sum_to_one_and_equal_dense_pagerank(spark):
    """Against PageRank on the dense sentence-by-sentence matrix."""
    import numpy as np
    docs = fx.documents(spark, SF)
    got = {}
    for r in TR.textrank_scores(docs, stop_words=None, max_iter=20, tol=None).collect():
        got.setdefault(r.doc_id, {})[r.idx] = r["rank"]
    assert all(sum(v.values()) == pytest.approx(1.0, abs=1e-9) for v in got.values())
    w = TR.tfidf(TR.sentences(docs.where("doc_id < 40"), "doc_id", "text"), None).collect()
    for d in list(got)[:40]:
        rows = [x for x in w if x.doc_id == d]
        if not rows:
            continue
        n, terms = len(got[d]), sorted({x.term for x in rows})
        m = np.zeros((n, len(terms)))
        for x in rows:
            m[x.idx, terms.index(x.term)] = x.w
        q = m @ m.T
        s = q.sum(axis=1)
        r = np.full(n, 1 / n)
        for _ in range(20):
            r = 0.15 / n + 0.85 * (q.T @ np.where(s > 0, r / np.where(s > 0, s, 1), 0) + r[s <= 0].sum() / n)
        assert [got[d][i] for i in range(n)] == pytest.approx(r.tolist(), abs=1e-9)


def test_null_and_blank_texts_keep_a_row(spark):
    got = _summ(spark, [(1, None), (2, ""), (3, "   ")])
    assert got == {1: "... (trimmed)", 2: "... (trimmed)", 3: "... (trimmed)"}


def test_string_ids_and_equal_scores_tie_to_the_earlier_sentence(spark):
    s = "alpha beta gamma delta epsilon zeta."
    df = spark.createDataFrame([("x9", " ".join([s] * 300))], "doc_id string, text string")
    r = TR.textrank_summarize(df, num_sentences=2).collect()[0]
    assert r.doc_id == "x9" and r.summary == f"{s} {s}"
    assert TR.textrank_scores(df).where("idx < 2").count() == 2


def test_convergence_mode(spark):
    docs = fx.documents(spark, SF)
    r = TR.textrank_scores(docs).collect()
    assert all(x.converged for x in r)


def test_batch_boundaries_and_partitions_do_not_change_results(spark):
    """Documents straddling Arrow batches (carry-over) and other partition
    counts must give the same summaries."""
    docs = fx.documents(spark, SF)
    base = {r.doc_id: r.summary for r in TR.textrank_summarize(docs, stop_words=None, max_iter=20,
                                                               tol=None).collect()}
    old_b = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    old_p = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        small = {r.doc_id: r.summary for r in TR.textrank_summarize(docs.repartition(5), stop_words=None,
                                                                    max_iter=20, tol=None).collect()}
        s1 = {(r.doc_id, r.idx): r.rank for r in TR.textrank_scores(docs, stop_words=None, max_iter=20,
                                                                     tol=None).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old_b)
        spark.conf.set("spark.sql.shuffle.partitions", old_p)
    assert small == base
    s2 = {(r.doc_id, r.idx): r.rank for r in TR.textrank_scores(docs, stop_words=None, max_iter=20,
                                                                 tol=None).collect()}
    assert s1.keys() == s2.keys()
    assert all(abs(s1[k] - s2[k]) < 1e-12 for k in s1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _query(spark, name):
    import __spark_entry__ as E
    return _plan(E.queries()[name](spark, "/root/testdata/sf0.001"))


def test_cosines_move_texts_once_a_side(spark):
    """a document's weights are figured where it is; the join of the two figures is all that follows."""
    plan = _query(spark, "sentence_cosine")
    assert plan.count("Exchange hashpartitioning") <= 4 and "idx#" not in plan.split("Exchange hashpartitioning")[-1].split(")")[0]


def test_tfidf_moves_texts_once(spark):
    """one exchange, and the weights are figured once."""
    plan = _query(spark, "tfidf_terms")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


def test_norms_move_texts_once(spark):
    """F4"""
    assert _query(spark, "sentence_norms").count("Exchange hashpartitioning") == 1


def test_doc_frequency_moves_texts_once(spark):
    """F10"""
    assert _query(spark, "doc_frequency").count("Exchange hashpartitioning") == 1


def test_ranks_are_figured_once_and_together(spark):
    """one call ranks many documents, and the plan calls it once."""
    import pyarrow as pa
    tokens = pa.array([[["aa", "bb"], ["bb", "cc"]], [], [[], []], [["xx"], ["yy"], []]])
    n, r, settled = TR._ranks(tokens, 0.85, 20, None)
    assert n.tolist() == [2, 0, 2, 3] and settled.tolist() == [True, True, False, True]
    assert abs(r[:2] - 0.5).max() < 1e-12 and abs(r[2:4] - 0.5).max() == 0 and abs(r[4:].sum() - 1) < 1e-9
    assert _query(spark, "textrank_scores").count("ArrowEvalPython") == 1


def test_nested_parts_equal_flat_parts_with_repeated_ids(spark):
    rows = [(1, "One two three four five six. Two three four five six seven two."), (1, "Six five four three two one. Nine."), (None, "A bb cc dd ee ff gg."),
            (2, "..... , , , , , . bb"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flat, nested = TR.sentences(df, "doc_id", "text", 2), TR.sentences(df, "doc_id", "text", 2, nested=True)
    rounded = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)
    assert rounded(TR.term_counts(flat)) == rounded(TR.flat(TR.term_counts(nested)))
    assert rounded(TR.doc_frequency(TR.term_counts(flat))) == rounded(TR.doc_frequency(TR.term_counts(nested)))
    a, b = TR.tfidf(flat), TR.tfidf(nested)
    assert rounded(a) == rounded(TR.flat(b)) and {r.doc_id for r in a.collect()} == {1}
    assert rounded(TR.sentence_norms(TR.tfidf_raw(flat))) == rounded(TR.sentence_norms(TR.tfidf_raw(nested)))
    for f in (TR.similarity_row_sums, TR.adjacent_cosine):
        assert rounded(f(a)) == rounded(f(b))
    # against the definition
    w = {}
    for r in a.where("doc_id = 1").collect():
        w.setdefault(r.idx, {})[r.term] = r.w
    dot = lambda x, y: sum(v * y.get(t, 0.0) for t, v in x.items())
    for r in TR.similarity_row_sums(b).where("doc_id = 1").collect():
        assert abs(r.s - sum(dot(w[r.idx], o) for o in w.values())) < 1e-9
    for r in TR.adjacent_cosine(b).where("doc_id = 1").collect():
        assert abs(r.cos_next - dot(w[r.idx], w[r.idx + 1])) < 1e-9
