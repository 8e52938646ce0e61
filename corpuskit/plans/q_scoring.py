"""Catalog entries for array scoring, classification, the document chain and the
pluggable scorer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpuskit.operators import labels as L
from corpuskit.operators import scoring as SC
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans import q_textrank as TQ
from corpuskit.plans.catalog import register
from corpuskit.plans.q_metrics import _duck_length_logits

_SOFTMAX = ("list_transform(logits, lambda x: exp(x - list_max(logits)) / "
            "list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))")


@register("softmax_argmax", fx.duck_with("v_logits") +
          f"SELECT vec_id, (list_position(p, list_max(p)) - 1)::BIGINT AS pred, round(list_max(p), 6) AS confidence, "
          f"round(list_sum(p), 6) AS prob_sum FROM (SELECT vec_id, {_SOFTMAX} AS p FROM v_logits)")
def q_softmax_argmax(spark, d):
    p = fx.v_logits(spark, d).select("vec_id", SC.softmax("logits").alias("p"))
    return p.select("vec_id", SC.argmax("p").alias("pred"), F.round(F.array_max("p"), 6).alias("confidence"),
                    F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("prob_sum"))


_DIM = {"dim": fx.duck_label_dim_values()}
_LOOKUP = ("CASE WHEN dim.label_name IS NOT NULL THEN dim.label_name "
           "WHEN q.task IN (SELECT task FROM dim) THEN 'ID_' || q.pid::VARCHAR || '_NotInMap' "
           "ELSE 'ID_' || q.pid::VARCHAR || '_NoMapForTask' END")


@register("classify", fx.duck_with("v_logits", extra=_DIM) +
          f", q AS (SELECT vec_id, ['scotus','unfair_tos','ledgar'][vec_id % 3 + 1] AS task, p, "
          "(list_position(p, list_max(p)) - 1)::BIGINT AS pid FROM (SELECT vec_id, "
          f"{_SOFTMAX} AS p FROM v_logits)) SELECT q.vec_id, q.task, q.pid AS predicted_label_id, "
          f"{_LOOKUP} AS predicted_label_name, round(list_max(q.p), 6) AS confidence "
          "FROM q LEFT JOIN dim ON dim.task = q.task AND dim.label_id = q.pid")
def q_classify(spark, d):
    lg = fx.v_logits(spark, d).withColumn(
        "task", F.element_at(F.array(F.lit("scotus"), F.lit("unfair_tos"), F.lit("ledgar")),
                             (F.col("vec_id") % 3 + 1).cast("int")))
    dim = L.label_dimension(fx.label_names_df(spark))
    c = SC.classify(lg, "logits", F.col("task"), dim)
    return c.select("vec_id", "task", "predicted_label_id", "predicted_label_name",
                    F.round("confidence", 6).alias("confidence"))


def _duck_dict_simplify(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fx.PLAIN_TERMS)
    return (f"array_to_string(list_transform(string_split({D.clean_text(x)}, ' '), "
            f"lambda w: coalesce(CASE lower(w) {cases} END, w)), ' ')")


# the summary of the whole text: TextRank by the oracle recipe, line tags, post-processing
_RANKED = dict(TQ.BASE + TQ.RANK)
_RANKED["rk"] = (f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(r * n, 6) DESC, idx) AS pos FROM r{TQ.ROUNDS}")
_RANKED["top"] = (f"SELECT doc_id, string_agg(sentence, '<n>' ORDER BY idx) AS summary FROM rk JOIN s0 USING (doc_id, idx) WHERE pos <= {TQ.K} GROUP BY doc_id")
_RANKED["raw"] = ("SELECT doc_id, text, CASE WHEN top.summary IS NULL THEN left(" + D.clean_text("text") +
                  ", 500) || '... (trimmed)' ELSE top.summary END AS raw FROM documents LEFT JOIN top USING (doc_id)")


_PROC_CTES = {
    **_RANKED,
    **_DIM,
    "base": f"SELECT doc_id, 'scotus' AS task, {_duck_length_logits('text')} AS logits, {D.post_process_summary('raw')} AS summary FROM raw",
    "sm": f"SELECT doc_id, task, summary, {_SOFTMAX} AS p FROM base",
    "q": "SELECT doc_id, task, summary, (list_position(p, list_max(p)) - 1)::BIGINT AS pid, list_max(p) AS conf FROM sm",
    "rec": f"SELECT q.doc_id, q.task, q.pid AS predicted_label_id, {_LOOKUP} AS predicted_label_name, NULL::VARCHAR AS error, "
           f"q.conf AS confidence, q.summary, {_duck_dict_simplify('q.summary')} AS simplified_summary "
           "FROM q LEFT JOIN dim ON dim.task = q.task AND dim.label_id = q.pid",
}
_RECIPE = {"stop_words": None, "max_iter": TQ.ROUNDS, "tol": None}


def _with(ctes):
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ctes.items()) + "\n"


def _process(spark, d, **options):
    dim = L.label_dimension(fx.label_names_df(spark))
    return SC.process_document(fx.documents(spark, d), "doc_id", "text", "scotus", dim, dict(fx.PLAIN_TERMS), **(_RECIPE | options))


def _record_sql(src="rec"):
    return ("SELECT doc_id, task, predicted_label_id, predicted_label_name, round(confidence, 6) AS confidence, error, summary, "
            f"simplified_summary, {D.word_count('summary')} AS summary_words, {D.word_count('simplified_summary')} AS simplified_words FROM {src}")


def _report_sql(src="rec"):
    return ("SELECT doc_id, '=== LEGAL DOCUMENT ANALYSIS ===' || chr(10) || chr(10) || 'CLASSIFICATION: ' || coalesce(predicted_label_name, 'Error') "
            "|| chr(10) || 'Confidence: ' || printf('%.4f', coalesce(confidence, 0)) || chr(10) || chr(10) || 'SUMMARY:' || chr(10) || summary "
            f"|| chr(10) || chr(10) || 'SIMPLIFIED SUMMARY:' || chr(10) || simplified_summary AS report FROM {src}")


@register("process_document", _with(_PROC_CTES) + _record_sql())
def q_process_document(spark, d):
    return _process(spark, d).withColumn("confidence", F.round("confidence", 6))


@register("report_text", _with(_PROC_CTES) + _report_sql())
def q_report_text(spark, d):
    r = _process(spark, d)
    return r.select("doc_id", SC.report_text(r).alias("report"))


@register("output_lengths", _with(_PROC_CTES) +
          f"SELECT doc_id, {D.word_count('summary')} AS summary_words, "
          f"{D.word_count('simplified_summary')} AS simplified_words FROM rec")
def q_output_lengths(spark, d):
    return _process(spark, d).select("doc_id", "summary_words", "simplified_words")


_FAILED = {"rec": "SELECT doc_id, 'scotus' AS task, NULL::BIGINT AS predicted_label_id, NULL::VARCHAR AS predicted_label_name, NULL::DOUBLE AS confidence, "
                  f"'RuntimeError: model weights unavailable' AS error, '{SC.SUMMARY_ERROR}' AS summary, '{SC.SIMPLIFY_ERROR}' AS simplified_summary FROM documents"}


@register("process_document_failures", _with(_FAILED) + _record_sql())
def q_process_document_failures(spark, d):
    """All back-ends fail: an error record, not an exception."""
    return _process(spark, d, classifiers=[_broken_model], summarizers=[_broken_model], simplifiers=[_broken_model])


_FALLBACKS = {"rec": "SELECT doc_id, 'scotus' AS task, NULL::BIGINT AS predicted_label_id, 'FALLBACK_LABEL_' || (n > 100)::INT AS predicted_label_name, "
                     "n / (n + 1) AS confidence, NULL::VARCHAR AS error, text AS summary, text AS simplified_summary FROM "
                     f"(SELECT doc_id, 'about ' || n::VARCHAR || ' words.' AS text, n FROM (SELECT doc_id, {D.word_count('text')} AS n FROM documents))"}


@register("process_document_models", _with(_FALLBACKS) + _record_sql())
def q_process_document_models(spark, d):
    """Caller-supplied back-ends: a broken classifier with a fall-back, a summarizer, a simplifier."""
    r = _process(spark, d, classifiers=[_broken_model, _scored_label_model], summarizers=[_word_count_model], simplifiers=[_same_model])
    return r.withColumn("confidence", F.round("confidence", 6))


@register("report_text_failures", _with(_FAILED) + _report_sql())
def q_report_text_failures(spark, d):
    r = _process(spark, d, classifiers=[_broken_model], summarizers=[_broken_model], simplifiers=[_broken_model])
    return r.select("doc_id", SC.report_text(r).alias("report"))


@register("dictionary_simplify",
          f"SELECT doc_id, {_duck_dict_simplify('text')} AS simplified FROM documents")
def q_dictionary_simplify(spark, d):
    terms = spark.createDataFrame(fx.PLAIN_TERMS, "term string, plain string")
    docs = fx.documents(spark, d)
    return SC.dictionary_simplify(docs, "doc_id", "text", terms).select("doc_id", "simplified")


# -- pluggable scorer: a failing primary and a working fallback -------------

def _broken_model():
    raise RuntimeError("model weights unavailable")


def _keyword_model():
    # a deterministic stand-in model: share of capitalised words in the text
    def score(texts: pd.Series) -> pd.Series:
        def one(t):
            ws = (t or "").split()
            return sum(1 for w in ws if w[:1].isupper()) / len(ws) if ws else 0.0
        return texts.map(one)
    return score


def _label_model():
    # a deterministic stand-in classifier: LABEL_1 for texts over 100 words
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "LABEL_1" if len((t or "").split()) > 100 else "LABEL_0")
    return score


def _scored_label_model():
    def score(texts: pd.Series) -> list:
        n = [len((t or "").split()) for t in texts]
        return [{"label": f"LABEL_{int(k > 100)}", "score": k / (k + 1)} for k in n]
    return score


def _word_count_model():
    return lambda texts: texts.map(lambda t: f"about {len((t or '').split())} words.")


def _same_model():
    return lambda texts: texts


@register("score_with_model", "SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: upper(left(x, 1)) = left(x, 1) "
          "AND lower(left(x, 1)) <> left(x, 1))) / len(w) END AS capital_share, 'fallback_1' AS backend, NULL::VARCHAR AS error "
          f"FROM (SELECT doc_id, {D.words('text')} AS w FROM documents)")
def q_score_with_model(spark, d):
    docs = fx.documents(spark, d)
    return SC.score_with_model(docs, [_broken_model, _keyword_model], "text", "capital_share", "double",
                               keep=["doc_id"]).select("doc_id", "capital_share", "backend", "error")
