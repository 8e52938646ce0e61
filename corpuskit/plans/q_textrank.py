"""Catalog entries for TextRank and its parts.

The oracle recipe (SURVEY Hard 1): no stop words, exactly 20 PageRank rounds,
scores times the number of sentences rounded to 6 places, ties broken by sentence index.  The DuckDB twin
unrolls the 20 rounds as materialized CTEs over the same factorised products.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import textrank as TR
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register

ROUNDS = 20
K = 5

_S0 = ("SELECT doc_id, (i - 1)::INTEGER AS idx, a[i] AS sentence FROM ("
       f"SELECT doc_id, {D.keep_long_sentences(D.split_sentences(D.clean_text('text')))} AS a FROM documents), "
       "LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")

BASE = [
    ("s0", _S0),
    ("n", "SELECT doc_id, count(*) AS n FROM s0 GROUP BY doc_id"),
    ("tc", "SELECT doc_id, idx, term, count(*) AS tf FROM (SELECT doc_id, idx, "
           f"unnest({D.lower_tokens('sentence')}) AS term FROM s0) GROUP BY ALL"),
    ("dfr", "SELECT doc_id, term, count(*) AS df FROM tc GROUP BY ALL"),
    ("x", "SELECT tc.doc_id, tc.idx, tc.term, tc.tf * (ln((1.0::DOUBLE + n.n) / (1.0::DOUBLE + dfr.df)) + 1.0) AS x "
          "FROM tc JOIN dfr USING (doc_id, term) JOIN n USING (doc_id)"),
    ("nr", "SELECT doc_id, idx, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL"),
    ("w", "SELECT x.doc_id, x.idx, x.term, x.x / nr.norm AS w FROM x JOIN nr USING (doc_id, idx)"),
]

RANK = [
    ("c", "SELECT doc_id, term, sum(w) AS c FROM w GROUP BY ALL"),
    ("rs", "SELECT w.doc_id, w.idx, sum(w.w * c.c) AS s FROM w JOIN c USING (doc_id, term) GROUP BY ALL"),
    ("r0", "SELECT s0.doc_id, s0.idx, n.n, coalesce(rs.s, 0.0) AS s, 1.0::DOUBLE / n.n AS r "
           "FROM s0 JOIN n USING (doc_id) LEFT JOIN rs USING (doc_id, idx)"),
]
for _k in range(1, ROUNDS + 1):
    p = f"r{_k - 1}"
    RANK += [
        (f"v{_k}", f"SELECT w.doc_id, w.term, sum(w.w * (q.r / q.s)) AS v FROM w JOIN {p} q USING (doc_id, idx) "
                   "WHERE q.s > 0 GROUP BY ALL"),
        (f"y{_k}", f"SELECT w.doc_id, w.idx, sum(w.w * v.v) AS y FROM w JOIN v{_k} v USING (doc_id, term) GROUP BY ALL"),
        (f"d{_k}", f"SELECT doc_id, sum(CASE WHEN s <= 0 THEN r ELSE 0.0 END) AS dm FROM {p} GROUP BY doc_id"),
        (f"r{_k}", f"SELECT q.doc_id, q.idx, q.n, q.s, 0.15 / q.n + 0.85 * (coalesce(y.y, 0.0) + d.dm / q.n) AS r "
                   f"FROM {p} q LEFT JOIN y{_k} y USING (doc_id, idx) JOIN d{_k} d USING (doc_id)"),
    ]


def _with(ctes) -> str:
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in ctes) + "\n"


def _oracle_scores(spark, d):
    return TR.textrank_scores(fx.documents(spark, d), "doc_id", "text", 5, stop_words=None, max_iter=ROUNDS, tol=None)


@register("textrank_scores", _with(BASE + RANK) +
          f"SELECT doc_id, idx, round(r * n, 6) AS score FROM r{ROUNDS}")
def q_textrank_scores(spark, d):
    return _oracle_scores(spark, d).select("doc_id", "idx", F.round(F.col("rank") * F.col("n"), 6).alias("score"))


_SUMMARY_SQL = _with(BASE + RANK + [
    ("rk", f"SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(r * n, 6) DESC, idx) AS pos "
           f"FROM r{ROUNDS}"),
    ("top", f"SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM rk JOIN s0 USING (doc_id, idx) "
            f"WHERE pos <= {K} GROUP BY doc_id"),
]) + ("SELECT doc_id, CASE WHEN top.summary IS NULL THEN left(" + D.clean_text("text") +
      ", 500) || '... (trimmed)' ELSE top.summary END AS summary FROM documents LEFT JOIN top USING (doc_id)")


@register("textrank_summary", _SUMMARY_SQL)
def q_textrank_summary(spark, d):
    return TR.textrank_summarize(fx.documents(spark, d), "doc_id", "text", K, 5, stop_words=None, max_iter=ROUNDS, tol=None)


def _w(spark, d):
    s = TR.sentences(fx.documents(spark, d), "doc_id", "text", nested=True)
    return TR.tfidf(s, None)


@register("tfidf_terms", _with(BASE) + "SELECT doc_id, idx, term, round(w, 6) AS w FROM w")
def q_tfidf_terms(spark, d):
    return TR.flat(_w(spark, d)).select("doc_id", "idx", "term", F.round("w", 6).alias("w"))


@register("doc_frequency", _with(BASE[:4]) + "SELECT doc_id, term, df FROM dfr")
def q_doc_frequency(spark, d):
    s = TR.sentences(fx.documents(spark, d), "doc_id", "text", nested=True)
    return TR.doc_frequency(TR.term_counts(s))


@register("sentence_norms", _with(BASE[:6]) + "SELECT doc_id, idx, round(norm, 6) AS norm FROM nr")
def q_sentence_norms(spark, d):
    s = TR.sentences(fx.documents(spark, d), "doc_id", "text", nested=True)
    return TR.sentence_norms(TR.tfidf_raw(s)).select("doc_id", "idx", F.round("norm", 6).alias("norm"))


@register("sentence_cosine", _with(BASE + RANK[:2] + [
    ("nx", "SELECT a.doc_id, a.idx, sum(a.w * b.w) AS cos_next FROM w a JOIN w b "
           "ON b.doc_id = a.doc_id AND b.idx = a.idx + 1 AND b.term = a.term GROUP BY ALL")]) +
          "SELECT rs.doc_id, rs.idx, round(rs.s, 6) AS sim_sum, round(coalesce(nx.cos_next, 0.0), 6) AS cos_next "
          "FROM rs LEFT JOIN nx USING (doc_id, idx)")
def q_sentence_cosine(spark, d):
    w = _w(spark, d)
    return (TR.similarity_row_sums(w).join(TR.adjacent_cosine(w), ["doc_id", "idx"], "left")
            .select("doc_id", "idx", F.round("s", 6).alias("sim_sum"),
                    F.round(F.coalesce("cos_next", F.lit(0.0)), 6).alias("cos_next")))
