"""Catalog entries for SARI, meaning preservation, readability and the metric callback."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from corpuskit.operators import simplification as S
from corpuskit.operators.callback import evaluate_with
from corpuskit.operators.scoring import argmax
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register
from corpuskit.plans.q_metrics import _ACC_SQL, _round_metrics

_LOW = lambda x: D.words(f"lower(coalesce({x}, ''))")


def _side(tokens: str, s: int, o: int, r: str, src: str) -> str:
    return (f"SELECT conv_id, n, array_to_string(t[i:i + n - 1], ' ') AS gram, {s} AS s, {o} AS o, {r} AS r FROM (SELECT conv_id, n, t, unnest(range(1, len(t) - n + 2)) AS i "
            f"FROM (SELECT conv_id, {tokens} AS t FROM {src}), (VALUES (1), (2), (3), (4)) AS k(n))")


_SARI_CTES = {
    "sa": "SELECT conv_id, original, simplifications[1] AS output, simplifications[2:] AS refs, len(simplifications) - 1 AS n_refs FROM v_turk WHERE len(simplifications) > 1",
    "rf": "SELECT conv_id, unnest(refs) AS ref FROM sa",
    "gr": f"{_side(_LOW('original'), 1, 0, '0', 'sa')} UNION ALL {_side(_LOW('output'), 0, 1, '0', 'sa')} UNION ALL {_side(_LOW('ref'), 0, 0, '1', 'rf')}",
    "gc": "SELECT conv_id, n, gram, sum(s) AS s, sum(o) AS o, sum(r) / any_value(n_refs) AS r FROM gr JOIN sa USING (conv_id) GROUP BY ALL",
    "gs": "SELECT conv_id, n, count(*) FILTER (o > 0 AND s = 0) AS added, count(*) FILTER (r > 0 AND s = 0) AS wanted, count(*) FILTER (o > 0 AND r > 0 AND s = 0) AS good, "
          "sum(least(s, o)) AS kept, sum(least(s, r)) AS keep, sum(least(s, o, r)) AS shared, sum(greatest(s - o, 0)) AS gone, "
          "sum(least(greatest(s - o, 0), greatest(s - r, 0))) AS rid FROM gc GROUP BY ALL",
    "gn": "SELECT sa.conv_id, k.n, CASE WHEN added > 0 THEN good / added ELSE 1 END AS pa, CASE WHEN wanted > 0 THEN good / wanted ELSE 1 END AS ra, "
          "CASE WHEN kept > 0 THEN shared / kept ELSE 1 END AS pk, CASE WHEN keep > 0 THEN shared / keep ELSE 1 END AS rk, CASE WHEN gone > 0 THEN rid / gone ELSE 1 END AS pd "
          "FROM sa CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(n) LEFT JOIN gs ON gs.conv_id = sa.conv_id AND gs.n = k.n",
    "gm": "SELECT conv_id, avg(pa) AS pa, avg(ra) AS ra, avg(pk) AS pk, avg(rk) AS rk, avg(pd) AS pd FROM gn GROUP BY conv_id",
}
_F = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


@register("sari", fx.duck_with("v_turk", extra=_SARI_CTES) +
          f"SELECT conv_id, round(100 * ({_F.format(p='pa', r='ra')} + {_F.format(p='pk', r='rk')} + pd) / 3, 6) AS sari FROM v_turk LEFT JOIN gm USING (conv_id)")
def q_sari(spark, d):
    """SARI of the first simplification of every conversation against its other ones."""
    t = fx.v_turk(spark, d).select("conv_id", "original", F.get("simplifications", 0).alias("output"),
                                   F.slice("simplifications", F.lit(2), F.greatest(F.size("simplifications"), F.lit(1))).alias("refs"))
    return S.sari(t, "original", "output", "refs").select("conv_id", F.round("sari", 6).alias("sari"))


_MEANING_CTES = {
    "pt": "SELECT conv_id, turn, term, sum(a) AS a, sum(b) AS b FROM ("
          f"SELECT conv_id, turn, unnest({D.lower_tokens('pred')}) AS term, 1 AS a, 0 AS b FROM v_pairs UNION ALL "
          f"SELECT conv_id, turn, unnest({D.lower_tokens('ref')}) AS term, 0 AS a, 1 AS b FROM v_pairs) GROUP BY ALL",
    "idf": "SELECT term, ln((1 + 2 * (SELECT count(*) FROM v_pairs)) / (1 + sum((a > 0)::INT + (b > 0)::INT))) + 1 AS idf FROM pt GROUP BY term",
    "cs": "SELECT conv_id, turn, sum(a * idf * b * idf) AS ab, sum(a * idf * a * idf) AS aa, sum(b * idf * b * idf) AS bb FROM pt JOIN idf USING (term) GROUP BY ALL",
}


@register("meaning_preservation", fx.duck_with("v_pairs", extra=_MEANING_CTES) +
          "SELECT conv_id, turn, round(coalesce(CASE WHEN aa > 0 AND bb > 0 THEN ab / sqrt(aa * bb) ELSE 0 END, 0), 6) AS meaning FROM v_pairs LEFT JOIN cs USING (conv_id, turn)")
def q_meaning_preservation(spark, d):
    """Cosine of every pair's texts, terms weighed by their rarity in the whole corpus."""
    return S.meaning_preservation(fx.v_pairs(spark, d), ["conv_id", "turn"], "pred", "ref").select("conv_id", "turn", F.round("meaning", 6).alias("meaning"))


@register("corpus_idf", fx.duck_with("v_pairs", extra=_MEANING_CTES) + "SELECT term, round(idf, 6) AS idf FROM idf")
def q_corpus_idf(spark, d):
    """Rarity of every term over all texts of the pairs."""
    p = fx.v_pairs(spark, d)
    return S.term_idf(S.pair_terms(p, ["conv_id", "turn"], "pred", "ref"), 2 * p.count()).select("term", F.round("idf", 6).alias("idf"))


_SPACED = "(' ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', '  ', 'g') || ' ')"
_COUNT = lambda pattern: f"len(regexp_extract_all(sp, '{pattern}'))"
_READ_CTES = {
    "sp": f"SELECT doc_id, lang, {_SPACED} AS sp, len(list_filter({D.split_sentences(D.clean_text("coalesce(text, '')"))}, lambda s: s <> '')) AS n_sentences FROM documents",
    "rd": f"SELECT doc_id, lang, n_sentences, {_COUNT(' \\p{L}+ ')} AS n_words, {_COUNT(f'[{S.VOWELS}]+')} - {_COUNT(f' [^ ]*[{S.VOWELS}][^ ]*[^{S.VOWELS}l ]e ')} "
          f"+ {_COUNT(f' [^{S.VOWELS} ]+ ')} AS n_syllables FROM sp",
}
_FLESCH = ("round(CASE WHEN n_words > 0 THEN 206.835 - 1.015 * (n_words / greatest(n_sentences, 1)) - 84.6 * (n_syllables / n_words) END, 6) AS reading_ease, "
           "round(CASE WHEN n_words > 0 THEN 0.39 * (n_words / greatest(n_sentences, 1)) + 11.8 * (n_syllables / n_words) - 15.59 END, 6) AS grade")


def _with(ctes: dict) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("reading_ease", "grade")})


@register("readability", _with(_READ_CTES) + f"SELECT doc_id, n_sentences, n_words, n_syllables, {_FLESCH} FROM rd")
def q_readability(spark, d):
    """Flesch figures of every document."""
    return _rounded(S.readability(fx.documents(spark, d))).drop("text")


@register("readability_by_lang", _with(_READ_CTES) + f"SELECT lang, n_texts, n_sentences, n_words, n_syllables, {_FLESCH} FROM (SELECT lang, count(*) AS n_texts, "
          "sum(n_sentences)::BIGINT AS n_sentences, sum(n_words)::BIGINT AS n_words, sum(n_syllables)::BIGINT AS n_syllables FROM rd GROUP BY lang)")
def q_readability_by_lang(spark, d):
    """Flesch figures of each language's documents together."""
    return _rounded(S.readability(fx.table(spark, d, "documents").select("lang", "text"), "text", ["lang"]))


# -- metric callback ------------------------------------------------------------

def _confusion(table: pa.Table) -> Counter:
    return Counter(zip(table["label"].to_pylist(), table["pred"].to_pylist()))


def _added(a: Counter, b: Counter) -> Counter:
    return a + b


def _figures(counts: Counter) -> dict:
    n = sum(counts.values())
    hits, support, predicted = Counter(), Counter(), Counter()
    for (label, pred), c in counts.items():
        support[label] += c
        predicted[pred] += c
        hits[label] += c if label == pred else 0
    f1 = 0.0
    for c, s in support.items():
        p, r = hits[c] / predicted[c] if predicted[c] else 0.0, hits[c] / s
        f1 += s * (2 * p * r / (p + r) if p + r else 0.0)
    return {"accuracy": sum(hits.values()) / n, "f1_weighted": f1 / n, "n": n}


@register("metric_callback", fx.duck_with("v_logits") +
          ", p AS (SELECT ['scotus','unfair_tos','ledgar'][vec_id % 3 + 1] AS task, label, (list_position(logits, list_max(logits)) - 1)::BIGINT AS pred FROM v_logits)" + _ACC_SQL)
def q_metric_callback(spark, d):
    """Accuracy and weighted F1 of each task as a user's own metric."""
    tasks = F.array(F.lit("scotus"), F.lit("unfair_tos"), F.lit("ledgar"))
    p = fx.v_logits(spark, d).select(F.element_at(tasks, (F.col("vec_id") % 3 + 1).cast("int")).alias("task"), "label", argmax("logits").alias("pred"))
    out = evaluate_with(p, ["label", "pred"], _confusion, _added, _figures, ["accuracy", "f1_weighted", "n"], "task")
    return _round_metrics(out.withColumn("n", F.col("n").cast("long")))
