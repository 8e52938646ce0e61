"""Catalog entries for classification and generation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import metrics as M
from corpuskit.operators.scoring import argmax, classify, length_logits
from corpuskit.functions.text import clean_text
from corpuskit.functions.postprocess import post_process_summary
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register
from corpuskit.plans.q_labels import std, with_std

IDS = ["conv_id", "turn"]


def _pairs(spark, d):
    return fx.v_pairs(spark, d)


def _duck_ngrams(tok_expr: str, orders: list[int], src: str = "v_pairs") -> str:
    vals = ", ".join(f"({n})" for n in orders)
    return (f"SELECT conv_id, turn, n, array_to_string(tok[i:i + n - 1], ' ') AS gram, count(*) AS cnt FROM "
            f"(SELECT conv_id, turn, {tok_expr} AS tok FROM {src}) t, (VALUES {vals}) AS o(n), "
            "LATERAL (SELECT unnest(range(1, len(tok) - n + 2)) AS i) GROUP BY ALL")


def _duck_overlap(pred_tok: str, ref_tok: str, orders: list[int], src: str = "v_pairs", pre: str = "") -> dict:
    """CTEs ``{pre}pc``, ``{pre}rc``, ``{pre}m``, ``{pre}ov``: clipped n-gram matches per (pair, order)."""
    vals = ", ".join(f"({n})" for n in orders)
    pc, rc, m = f"{pre}pc", f"{pre}rc", f"{pre}m"
    return {
        pc: _duck_ngrams(pred_tok.format(c="pred"), orders, src),
        rc: _duck_ngrams(ref_tok.format(c="ref"), orders, src),
        m: f"SELECT conv_id, turn, n, sum(least({pc}.cnt, {rc}.cnt)) AS match FROM {pc} JOIN {rc} "
           "USING (conv_id, turn, n, gram) GROUP BY ALL",
        f"{pre}ov": f"SELECT p.conv_id, p.turn, o.n, len({pred_tok.format(c='p.pred')}) AS len_pred, "
                    f"len({ref_tok.format(c='p.ref')}) AS len_ref, coalesce({m}.match, 0) AS match FROM {src} p "
                    f"CROSS JOIN (VALUES {vals}) AS o(n) LEFT JOIN {m} ON {m}.conv_id = p.conv_id "
                    f"AND {m}.turn = p.turn AND {m}.n = o.n",
    }


_RT = D.rouge_tokens("{c}")
_WT = D.words("{c}")

_ROUGE_CTES = dict(_duck_overlap(_RT, _RT, [1, 2]))
_ROUGE_CTES["rg"] = ("SELECT conv_id, turn, n, match / greatest(greatest(len_pred - n + 1, 0), 1) AS p, "
                     "match / greatest(greatest(len_ref - n + 1, 0), 1) AS r FROM ov")
_ROUGE_CTES["rf"] = "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM rg"

_BLEU_CTES = _duck_overlap(_WT, _WT, [1, 2, 3, 4], pre="b")
_BLEU_CTES["bl"] = ("SELECT conv_id, turn, any_value(len_pred) AS c, any_value(len_ref) AS r, "
                    "sum(CASE WHEN n = 1 THEN match ELSE 0 END) AS m1, "
                    "sum(ln(CASE WHEN match = 0 THEN 0.1 / greatest(len_pred - n + 1, 1) "
                    "ELSE match / greatest(len_pred - n + 1, 1) END) / 4) AS logp FROM bov GROUP BY ALL")
_BLEU_CTES["bs"] = ("SELECT conv_id, turn, c, CASE WHEN m1 = 0 THEN 0.0 ELSE (CASE WHEN c > r THEN 1.0 WHEN c = 0 "
                    "THEN 0.0 ELSE exp(1 - r / c) END) * exp(logp) END AS bleu FROM bl")


def _w(extra=None):
    return fx.duck_with("v_pairs", extra=extra)


@register("rouge1", _w(extra=_ROUGE_CTES) +
          "SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS fmeasure "
          "FROM rf WHERE n = 1")
def q_rouge1(spark, d):
    r = M.rouge_n(_pairs(spark, d), IDS, "pred", "ref", (1,)).where("n = 1")
    return r.select(*IDS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fmeasure")])


@register("rouge2", _w(extra=_ROUGE_CTES) +
          "SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS fmeasure "
          "FROM rf WHERE n = 2")
def q_rouge2(spark, d):
    r = M.rouge_n(_pairs(spark, d), IDS, "pred", "ref", (2,)).where("n = 2")
    return r.select(*IDS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fmeasure")])


@register("corpus_rouge", _w(extra=_ROUGE_CTES) +
          "SELECT round(coalesce(avg(f) FILTER (WHERE n = 1), 0) * 100, 4) AS rouge1, "
          "round(coalesce(avg(f) FILTER (WHERE n = 2), 0) * 100, 4) AS rouge2 FROM rf")
def q_corpus_rouge(spark, d):
    r = M.rouge_n(_pairs(spark, d), IDS, "pred", "ref", (1, 2))
    return r.agg(F.round(F.coalesce(F.avg(F.when(F.col("n") == 1, F.col("fmeasure"))), F.lit(0.0)) * 100, 4).alias("rouge1"),
                 F.round(F.coalesce(F.avg(F.when(F.col("n") == 2, F.col("fmeasure"))), F.lit(0.0)) * 100, 4).alias("rouge2"))


@register("gen_len", fx.duck_with("v_pairs") +
          f"SELECT round(coalesce(avg({D.word_count('pred')}), 0), 4) AS gen_len FROM v_pairs")
def q_gen_len(spark, d):
    return _pairs(spark, d).agg(F.round(F.coalesce(F.avg(M.word_count("pred")), F.lit(0.0)), 4).alias("gen_len"))


@register("bleu", _w(extra=_BLEU_CTES) + "SELECT conv_id, turn, round(bleu, 6) AS bleu FROM bs")
def q_bleu(spark, d):
    return M.bleu(_pairs(spark, d), IDS, "pred", "ref").select(*IDS, F.round("bleu", 6).alias("bleu"))


@register("bleu_corpus", _w(extra=_BLEU_CTES) +
          "SELECT round(coalesce(avg(bleu) FILTER (WHERE c > 0), 0) * 100, 2) AS bleu FROM bs")
def q_bleu_corpus(spark, d):
    b = M.bleu(_pairs(spark, d), IDS, "pred", "ref")
    return b.agg(F.round(F.coalesce(F.avg(F.when(F.col("c") > 0, F.col("bleu"))), F.lit(0.0)) * 100, 2).alias("bleu"))


_GEN_SQL = ("SELECT (SELECT round(coalesce(avg(f) FILTER (WHERE n = 1), 0) * 100, 4) FROM rf) AS rouge1, "
            "(SELECT round(coalesce(avg(f) FILTER (WHERE n = 2), 0) * 100, 4) FROM rf) AS rouge2, "
            f"(SELECT round(coalesce(avg({D.word_count('pred')}), 0), 4) FROM v_pairs) AS gen_len, "
            "(SELECT count(*) FROM v_pairs) AS n_pairs, "
            "(SELECT round(coalesce(avg(bleu) FILTER (WHERE c > 0), 0) * 100, 2) FROM bs) AS bleu")


@register("evaluate_generation", _w(extra={**_ROUGE_CTES, **_BLEU_CTES}) + _GEN_SQL)
def q_evaluate_generation(spark, d):
    return M.generation_metrics(_pairs(spark, d), IDS, "pred", "ref", with_lcs=False)


# ROUGE-L: element k of the fold's state is the smallest end in the reference of a common subsequence of k tokens
_LCS_CTES = {
    "lt": f"SELECT conv_id, turn, {_RT.format(c='pred')} AS a, {_RT.format(c='ref')} AS b FROM v_pairs",
    "ls": "SELECT conv_id, turn, len(a) AS len_pred, len(b) AS len_ref, len(list_reduce(list_concat([[]::BIGINT[]], "
          "list_transform(a, lambda x: list_filter(range(1, len(b) + 1), lambda j: b[j] = x))), "
          "lambda t, ps: list_filter(list_transform(range(1, len(t) + 2), lambda k: least(coalesce(t[k], 1000000000), "
          "coalesce(list_min(list_filter(ps, lambda p: p > coalesce(t[k - 1], 0))), 1000000000))), lambda e: e < 1000000000))) AS lcs FROM lt",
    "lf": "SELECT *, CASE WHEN lcs > 0 THEN 2 * (lcs / len_pred) * (lcs / len_ref) / (lcs / len_pred + lcs / len_ref) ELSE 0.0 END AS f FROM ls",
}


@register("rougeL", _w(extra=_LCS_CTES) + "SELECT conv_id, turn, round(f, 6) AS fmeasure FROM lf")
def q_rouge_l(spark, d):
    return M.rouge_l(_pairs(spark, d), IDS, "pred", "ref").select(*IDS, F.round("fmeasure", 6).alias("fmeasure"))


@register("evaluate_generation_lcs", _w(extra={**_ROUGE_CTES, **_BLEU_CTES, **_LCS_CTES}) + _GEN_SQL +
          ", (SELECT round(coalesce(avg(f), 0) * 100, 4) FROM lf) AS \"rougeL\"")
def q_evaluate_generation_lcs(spark, d):
    """C9 with all its figures, ROUGE-L among them."""
    return M.generation_metrics(_pairs(spark, d), IDS, "pred", "ref")


@register("pred_ref_join", fx.duck_with("v_pairs") +
          "SELECT p.conv_id, p.turn, " + D.post_process_summary(f"replace({D.clean_text('p.pred')}, '. ', '.<n>')") +
          " AS prediction, r.ref AS reference FROM v_pairs p JOIN v_pairs r USING (conv_id, turn)")
def q_pred_ref_join(spark, d):
    """J2 over whole texts: every sentence of a turn on its own line, post-processed, with its reference."""
    p = _pairs(spark, d)
    preds = p.select(*IDS, post_process_summary(F.replace(clean_text("pred"), F.lit(". "), F.lit(".<n>"))).alias("prediction"))
    refs = p.select(*IDS, F.col("ref").alias("reference"))
    return M.pred_ref_join(preds, refs, IDS)


_ACC_SQL = """, f AS (SELECT task, label, pred, count(*) AS n FROM p GROUP BY ALL),
tp AS (SELECT task, label AS c, sum(n) AS tp FROM f WHERE label = pred GROUP BY ALL),
sp AS (SELECT task, label AS c, sum(n) AS support FROM f GROUP BY ALL),
pr AS (SELECT task, pred AS c, sum(n) AS predicted FROM f GROUP BY ALL),
per AS (SELECT coalesce(sp.task, pr.task) AS task, coalesce(sp.c, pr.c) AS c, coalesce(support, 0) AS support,
        coalesce(predicted, 0) AS predicted FROM sp FULL JOIN pr ON sp.task = pr.task AND sp.c = pr.c),
per2 AS (SELECT per.*, coalesce(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON tp.task = per.task AND tp.c = per.c),
per3 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pp,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rr FROM per2)
SELECT task, round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END * support) / sum(support), 6) AS f1_weighted,
  sum(support)::BIGINT AS n FROM per3 GROUP BY task"""


def _round_metrics(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "f1_weighted") else F.col(c) for c in df.columns])


@register("accuracy_f1", fx.duck_with("v_logits") +
          ", p AS (SELECT ['scotus','unfair_tos','ledgar'][vec_id % 3 + 1] AS task, label, "
          "(list_position(logits, list_max(logits)) - 1)::BIGINT AS pred FROM v_logits)" + _ACC_SQL)
def q_accuracy_f1(spark, d):
    lg = fx.v_logits(spark, d)
    p = lg.select(F.element_at(F.array(F.lit("scotus"), F.lit("unfair_tos"), F.lit("ledgar")),
                               (F.col("vec_id") % 3 + 1).cast("int")).alias("task"),
                  "label", argmax("logits").alias("pred"))
    return _round_metrics(M.classification_metrics(p, "task", "label", "pred"))


def _duck_length_logits(t: str) -> str:
    w = f"string_split({D.clean_text(t)}, ' ')"
    n = f"greatest(len(list_filter({w}, lambda x: x <> '')), 1)"
    s = f"len(list_filter({w}, lambda x: length(x) > 0 AND length(x) <= 4))"
    lo = f"len(list_filter({w}, lambda x: length(x) > 4))"
    return f"[{s} * 4.0 / {n}, {lo} * 4.0 / {n}]::DOUBLE[]"


@register("evaluate_classifier", with_std(extra={"lg": "SELECT task_name AS task, input_label AS label, "
                                                       f"{_duck_length_logits('input_text')} AS logits FROM std "
                                                       "WHERE split = 'test'"}) +
          ", p AS (SELECT task, label, (list_position(logits, list_max(logits)) - 1)::BIGINT AS pred FROM lg)" + _ACC_SQL)
def q_evaluate_classifier(spark, d):
    """Per-task accuracy / weighted F1 on the test split; tasks without a
    test split drop out naturally (no rows)."""
    t = std(spark, d, splits=["test"]).withColumn("_lg", length_logits("input_text"))
    c = classify(t, "_lg", F.col("task_name"))
    p = c.select("task", F.col("input_label").alias("label"), F.col("predicted_label_id").alias("pred"))
    return _round_metrics(M.classification_metrics(p, "task", "label", "pred"))
