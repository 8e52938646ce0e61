"""Catalog entries for what is learned from the corpus: abbreviations, the frequency vocabulary, stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import porter
from corpuskit.functions.text import rouge_tokens
from corpuskit.operators import abbreviations as A
from corpuskit.operators import metrics as M
from corpuskit.operators import vocabulary as V
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register
from corpuskit.plans.q_metrics import _LCS_CTES, _duck_overlap

IDS = ["conv_id", "turn"]

# -- abbreviations ------------------------------------------------------------

_BARE = "regexp_replace(regexp_replace(lower({t}), '^[^\\p{{L}}]+', ''), '[^\\p{{L}}.]+$', '')"
_ABBREVIATION_CTES = {
    "tok": f"SELECT {_BARE.format(t='t')} AS t FROM (SELECT unnest(string_split({D.clean_text('text')}, ' ')) AS t FROM documents)",
    "pcount": "SELECT regexp_replace(t, '\\.+$', '') AS type, count(*) FILTER (ends_with(t, '.') AND NOT ends_with(t, '..')) AS n_with, "
              "count(*) FILTER (NOT (ends_with(t, '.') AND NOT ends_with(t, '..'))) AS n_without FROM tok "
              f"WHERE regexp_matches(regexp_replace(t, '\\.+$', ''), '{A.TYPE}') GROUP BY 1",
    "share": "SELECT sum(n_with) / (sum(n_with) + sum(n_without)) AS p FROM pcount",
    "scored": f"SELECT type, n_with, n_without, 2 * ((n_with * ln({A.P_ABBREVIATION}) + n_without * ln(1 - {A.P_ABBREVIATION}::DOUBLE)) - (n_with * ln(p) + n_without * ln(1 - p))) "
              "* exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1) "
              "* pow(length(replace(type, '.', '')), -n_without) AS score FROM pcount, share WHERE n_with > 0",
    "abbr": f"SELECT * FROM scored WHERE score >= {A.THRESHOLD}",
}


def _with(ctes: dict) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


@register("abbreviations", _with(_ABBREVIATION_CTES) + "SELECT type, n_with, n_without, round(score, 6) AS score FROM abbr")
def q_abbreviations(spark, d):
    """The corpus's abbreviations and their scores."""
    return A.learn_abbreviations(fx.documents(spark, d)).select("type", "n_with", "n_without", F.round("score", 6).alias("score"))


_TYPE_OF_LAST = f"regexp_replace({_BARE.format(t="string_split(p, ' ')[-1]")}, '\\.+$', '')"
_LEARNED_SPLIT = (", known AS (SELECT list(type) AS known FROM abbr), pieces AS (SELECT doc_id, known, "
                  f"{D.split_sentences(D.clean_text('text'))} AS a FROM documents, known), "
                  "joined AS (SELECT doc_id, a, string_split(array_to_string(list_transform(a[1:len(a) - 1], lambda p: p || CASE WHEN ends_with(p, '.') AND NOT "
                  f"ends_with(p, '..') AND list_contains(known, {_TYPE_OF_LAST}) THEN ' ' ELSE chr(1) END), '') || a[-1], chr(1)) AS s FROM pieces) ")


@register("sentence_split_learned", _with(_ABBREVIATION_CTES).rstrip() + _LEARNED_SPLIT +
          "SELECT doc_id, len(s) AS n_sentences, len(a) - len(s) AS n_joined, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM joined")
def q_sentence_split_learned(spark, d):
    """Sentences of whole texts, split by the abbreviations that the corpus itself shows."""
    docs = fx.documents(spark, d)
    s = A.split_learned(docs, A.learn_abbreviations(docs), plain="n_plain")
    return s.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), (F.col("n_plain") - F.size("sentences")).cast("bigint").alias("n_joined"),
                    F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"))


# -- vocabulary -----------------------------------------------------------------

_VOCABULARY_CTES = {
    "counted": f"SELECT token, count(*) AS n FROM (SELECT unnest({D.lower_tokens('text')}) AS token FROM documents) GROUP BY token",
    "vocabulary": f"SELECT * FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + {V.FIRST_ID - 1} AS token_id FROM counted) WHERE token_id < {V.DEFAULT_SIZE}",
}


@register("vocabulary", _with(_VOCABULARY_CTES) + "SELECT token, n, token_id FROM vocabulary")
def q_vocabulary(spark, d):
    """The 30,000 ids of the corpus's most frequent tokens."""
    return V.build_vocabulary(fx.documents(spark, d)).select("token", "n", "token_id")


@register("encode_vocabulary", _with(_VOCABULARY_CTES).rstrip() + f", cut AS (SELECT doc_id, {D.lower_tokens('text')}[1:512] AS t FROM documents), "
          f"ids AS (SELECT doc_id, list(coalesce(token_id, {V.UNKNOWN_ID}) ORDER BY i) AS ids FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM cut) c "
          "LEFT JOIN vocabulary v ON v.token = c.token GROUP BY doc_id) "
          "SELECT doc_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(512 - len(coalesce(ids, []))), lambda z: 0)), ',') AS input_ids, "
          "array_to_string(list_concat(list_transform(range(len(coalesce(ids, []))), lambda z: 1), list_transform(range(512 - len(coalesce(ids, []))), lambda z: 0)), ',') "
          "AS attention_mask FROM documents LEFT JOIN ids USING (doc_id)")
def q_encode_vocabulary(spark, d):
    """Ids of the frequency vocabulary, fixed length 512, and the mask from the same tokens."""
    docs = fx.documents(spark, d)
    enc = V.encode_with_vocabulary(docs, V.build_vocabulary(docs), "text", 512)
    return enc.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


# -- stems --------------------------------------------------------------------

def _measure(cut: int) -> str:
    left = f"left(k, length(k) - {cut})"
    return f"((length({left}) - length(replace({left}, 'vc', ''))) // 2)"


def _rules(table, cond, otherwise="w") -> str:
    out = "CASE"
    for suffix, new in sorted(table, key=lambda r: -len(r[0])):
        n = len(suffix)
        out += f" WHEN ends_with(w, '{suffix}') THEN CASE WHEN {cond(suffix, n)} THEN left(w, length(w) - {n}) || '{new}' ELSE w END"
    return f"{out} ELSE {otherwise} END"


def _stem_ctes(words: str) -> dict:
    """CTE ``stems(word, stem)`` of the distinct words of the relation ``words(word)``."""
    k = ("list_reduce(list_prepend('', string_split(w, '')), lambda acc, ch: acc || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') OR (ch = 'y' AND right(acc, 1) = 'c') "
         "THEN 'v' ELSE 'c' END)")
    short = "((right(k, 3) = 'cvc' AND right(w, 1) NOT IN ('w', 'x', 'y')) OR k = 'vc')"
    positive = lambda s, n: f"{_measure(n)} > 0"
    end = lambda s: f"ends_with(w, '{s}')"
    steps = [
        f"CASE WHEN length(w) = 4 AND {end('ies')} THEN left(w, 3) ELSE {_rules(porter.STEP_1A, lambda s, n: 'TRUE')} END AS w, FALSE AS cut",
        f"CASE WHEN {end('ied')} THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END) WHEN {end('eed')} THEN CASE WHEN {_measure(3)} > 0 THEN left(w, length(w) - 1) ELSE w END "
        f"WHEN {end('ed')} AND contains(left(k, length(k) - 2), 'v') THEN left(w, length(w) - 2) WHEN {end('ing')} AND contains(left(k, length(k) - 3), 'v') THEN left(w, length(w) - 3) ELSE w END AS w, "
        f"NOT {end('ied')} AND NOT {end('eed')} AND (({end('ed')} AND contains(left(k, length(k) - 2), 'v')) OR ({end('ing')} AND contains(left(k, length(k) - 3), 'v'))) AS cut",
        f"CASE WHEN NOT cut THEN w WHEN {end('at')} OR {end('bl')} OR {end('iz')} THEN w || 'e' WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND right(k, 1) = 'c' "
        f"THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, length(w) - 1) END WHEN {_measure(0)} = 1 AND {short} THEN w || 'e' ELSE w END AS w, FALSE AS cut",
        f"CASE WHEN {end('y')} AND length(w) > 2 AND right(left(k, length(k) - 1), 1) = 'c' THEN left(w, length(w) - 1) || 'i' ELSE w END AS w, FALSE AS cut",
        f"CASE WHEN {end('alli')} AND {_measure(4)} > 0 THEN left(w, length(w) - 2) ELSE w END AS w, FALSE AS cut",
        f"CASE WHEN {end('logi')} THEN CASE WHEN {_measure(3)} > 0 THEN left(w, length(w) - 1) ELSE w END ELSE {_rules(porter.STEP_2, positive)} END AS w, FALSE AS cut",
        f"{_rules(porter.STEP_3, positive)} AS w, FALSE AS cut",
        f"""{_rules([(s, '') for s in porter.STEP_4], lambda s, n: f"{_measure(n)} > 1" + (f" AND right(left(w, length(w) - {n}), 1) IN ('s', 't')" if s == 'ion' else ''))} AS w, FALSE AS cut""",
        f"""CASE WHEN {end('e')} AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT ((right(left(k, length(k) - 1), 3) = 'cvc' AND substr(w, length(w) - 1, 1) NOT IN ('w', 'x', 'y'))
        OR left(k, length(k) - 1) = 'vc'))) THEN left(w, length(w) - 1) ELSE w END AS w, FALSE AS cut""",
        f"CASE WHEN {end('ll')} AND {_measure(1)} > 1 THEN left(w, length(w) - 1) ELSE w END AS w, FALSE AS cut",
    ]
    ctes = {"st0": f"SELECT DISTINCT word, word AS w, FALSE AS cut FROM ({words}) WHERE length(word) > {porter.STEM_ABOVE}"}
    for i, step in enumerate(steps):
        ctes[f"st{i + 1}"] = f"SELECT word, {step} FROM (SELECT *, {k} AS k FROM st{i})"
    odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in porter.IRREGULAR.items())
    ctes["stems"] = f"SELECT word, CASE word {odd} ELSE w END AS stem FROM st{len(steps)}"
    return ctes


_WORDS = f"SELECT unnest({D.rouge_tokens('pred')}) AS word FROM v_pairs UNION ALL SELECT unnest({D.rouge_tokens('ref')}) AS word FROM v_pairs"


@register("porter_stems", fx.duck_with("v_pairs", extra=_stem_ctes(_WORDS)) + "SELECT word, stem FROM stems")
def q_porter_stems(spark, d):
    """The stem of every distinct word of more than three letters."""
    p = fx.v_pairs(spark, d)
    words = p.select(F.explode(F.concat(rouge_tokens("pred"), rouge_tokens("ref"))).alias("word")).where(F.length("word") > porter.STEM_ABOVE).distinct()
    return words.select("word", F.get(porter.stem_tokens(F.array("word")), 0).alias("stem"))


def _stemmed(side: str) -> str:
    return (f"SELECT conv_id, turn, list(coalesce(stem, word) ORDER BY i) AS t FROM (SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) AS i "
            f"FROM (SELECT conv_id, turn, {D.rouge_tokens(side)} AS t FROM v_pairs)) LEFT JOIN stems USING (word) GROUP BY ALL")


_STEMMED_CTES = _stem_ctes(_WORDS) | {
    "sp": _stemmed("pred"), "sr": _stemmed("ref"),
    "stemmed": "SELECT v.conv_id, v.turn, coalesce(sp.t, []) AS pred, coalesce(sr.t, []) AS ref FROM v_pairs v LEFT JOIN sp USING (conv_id, turn) LEFT JOIN sr USING (conv_id, turn)",
    **_duck_overlap("{c}", "{c}", [1, 2], src="stemmed", pre="s"),
    "lt": "SELECT conv_id, turn, pred AS a, ref AS b FROM stemmed", "ls": _LCS_CTES["ls"], "lf": _LCS_CTES["lf"],
    "sf": "SELECT conv_id, turn, n, match / greatest(len_pred - n + 1, 1) AS p, match / greatest(len_ref - n + 1, 1) AS r FROM sov",
    "sg": "SELECT conv_id, turn, max(CASE WHEN n = 1 THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END END) AS rouge1, "
          "max(CASE WHEN n = 2 THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END END) AS rouge2 FROM sf GROUP BY ALL",
}


@register("rouge_stemmed", fx.duck_with("v_pairs", extra=_STEMMED_CTES) +
          "SELECT conv_id, turn, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(f, 6) AS \"rougeL\" FROM sg JOIN lf USING (conv_id, turn)")
def q_rouge_stemmed(spark, d):
    """ROUGE-1, ROUGE-2 and ROUGE-L of every pair on Porter stems."""
    p = fx.v_pairs(spark, d)
    return M.rouge_scores(p, IDS, "pred", "ref", stemmer=M.PORTER).select(*IDS, *[F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


@register("evaluate_generation_stemmed", fx.duck_with("v_pairs", extra=_STEMMED_CTES) +
          "SELECT round(coalesce(avg(rouge1), 0) * 100, 4) AS rouge1, round(coalesce(avg(rouge2), 0) * 100, 4) AS rouge2, "
          "(SELECT round(coalesce(avg(f), 0) * 100, 4) FROM lf) AS \"rougeL\", "
          f"(SELECT round(coalesce(avg({D.word_count('pred')}), 0), 4) FROM v_pairs) AS gen_len, count(*) AS n_pairs FROM sg")
def q_evaluate_generation_stemmed(spark, d):
    """C9 with stems, as the reference computes its ROUGE figures."""
    return M.generation_metrics(fx.v_pairs(spark, d), IDS, "pred", "ref", with_bleu=False, stemmer=M.PORTER)
