"""Evaluation metrics: accuracy, weighted F1, ROUGE-1/2/L, BLEU and their corpus
averages (J2, A8-A13, X11-X14, C8, C9).

A prediction and its reference are one row, so every score is row-local: clipped
n-gram counts and a bit-parallel LCS in Arrow-batched functions over native token
arrays, the formulas as column expressions.  The only shuffle is the final one-row mean.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import porter
from corpuskit.functions.common import to_col
from corpuskit.functions.text import rouge_tokens, word_count, words

PORTER = "porter"  # as a ``stemmer``: the bundled one
PAIR_ROWS = 1024  # pairs that are handled at once


# -- classification -----------------------------------------------------------

def classification_metrics(df: DataFrame, group: str | None, label: str = "label",
                           pred: str = "pred") -> DataFrame:
    """A8 + A9: accuracy and support-weighted F1 (zero_division=0) per group.

    Built from the confusion counts ``(group, label, pred, n)``, bounded by groups ×
    classes²: each count goes to its label (hits, support) and to its prediction, one
    grouped sum per class, one per group — no join.  Without rows all figures are 0.
    """
    g = [group] if group else []
    conf = df.groupBy(*g, label, pred).agg(F.count("*").alias("n"))
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(F.struct(F.col(label).alias("c"), hit.cast("bigint").alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
                    F.struct(F.col(pred).alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")))
    per = conf.select(*g, F.explode(sides).alias("s")).groupBy(*g, F.col("s.c").alias("c")).agg(
        *[F.sum(f"s.{k}").alias(k) for k in ("tp", "support", "predicted")])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    per = per.withColumn("f1", f1)
    total = F.sum("support")
    share = lambda x: F.coalesce(F.when(total > 0, x / total), F.lit(0.0))
    return per.groupBy(*g).agg(share(F.sum("tp")).alias("accuracy"),
                               share(F.sum(F.col("f1") * F.col("support"))).alias("f1_weighted"),
                               F.coalesce(total, zero).alias("n"))


# -- n-gram helpers -------------------------------------------------------------

def _clipped(pred, ref, n: int) -> int:
    """n-grams that both token lists hold, each as often as in the one that has it less."""
    a = Counter(zip(*[pred[i:] for i in range(n)]))
    b = Counter(zip(*[ref[i:] for i in range(n)]))
    if len(b) < len(a):
        a, b = b, a
    return sum(min(c, b[g]) for g, c in a.items() if g in b)


def _codes(tokens: pa.Array, stemmed: bool) -> np.ndarray:
    """A number for each token, the same for equal ones."""
    d = tokens.dictionary_encode()
    at = d.indices.to_numpy(zero_copy_only=False)
    return porter.stems_of(d.dictionary).dictionary_encode().indices.to_numpy(zero_copy_only=False)[at] if stemmed else at


def pair_figures(pred: Column, ref: Column, orders=(), lcs: bool = False, stemmed: bool = False) -> Column:
    """``struct<match: array<int>, lcs: int>`` of two token arrays: clipped matches per order and the length of the longest
    common subsequence (0 unless ``lcs``), on Porter stems where ``stemmed``.  In place: a pair is one row, so nothing is
    shuffled, and one Python worker a task does all of it, on token numbers of PAIR_ROWS rows at a time."""
    orders = list(orders)

    def one(p: pa.Array, r: pa.Array) -> pa.Array:
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (p, r)]
        codes = _codes(pa.concat_arrays([p.flatten(), r.flatten()]), stemmed)
        at, bt = 0, int(sizes[0].sum())
        match, common = [], []
        for n_a, n_b in zip(*[s.tolist() for s in sizes]):
            a, b = codes[at:at + n_a].tolist(), codes[bt:bt + n_b].tolist()
            at, bt = at + n_a, bt + n_b
            match.append([_clipped(a, b, n) for n in orders])
            common.append(lcs_length(a, b) if lcs else 0)
        return pa.StructArray.from_arrays([pa.array(match, pa.list_(pa.int32())), pa.array(common, pa.int32())], ["match", "lcs"])

    def run(p: pa.Array, r: pa.Array) -> pa.Array:
        return pa.concat_arrays([one(p.slice(i, PAIR_ROWS), r.slice(i, PAIR_ROWS)) for i in range(0, max(len(p), 1), PAIR_ROWS)])
    return F.arrow_udf(run, "struct<match: array<int>, lcs: int>")(pred, ref)


def _overlap(df: DataFrame, id_cols, pred_tokens: Column, ref_tokens: Column, orders, stemmed: bool = False) -> DataFrame:
    """Both lengths and the clipped n-gram matches (one array element per order)."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    t = df.select(*id_cols, pred_tokens.alias("_p"), ref_tokens.alias("_r"))
    return t.select(*id_cols, F.greatest(F.size("_p"), F.lit(0)).alias("len_pred"), F.greatest(F.size("_r"), F.lit(0)).alias("len_ref"),
                    pair_figures(F.col("_p"), F.col("_r"), orders, stemmed=stemmed)["match"].alias("match"))


def _prf(match: Column, total_pred: Column, total_ref: Column) -> Column:
    p, r = match / F.greatest(total_pred, F.lit(1)), match / F.greatest(total_ref, F.lit(1))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("fmeasure"))


def _rouge_scores(o: DataFrame, orders) -> list[Column]:
    """A struct of precision, recall and fmeasure per order."""
    return [_prf(F.get("match", i), F.col("len_pred") - n + 1, F.col("len_ref") - n + 1) for i, n in enumerate(orders)]


def stem_tokens(tokens, stemmer) -> Column:
    """X13 hook: apply a caller-supplied stemmer (``str -> str``) to tokens longer
    than 3 characters, as the ROUGE tokenizer does; Arrow-batched pandas UDF."""
    from corpuskit.session import ship_package
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)

    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda ts: [stemmer(t) if len(t) > 3 else t for t in ts] if ts is not None else [])
    return F.pandas_udf(run, "array<string>")(to_col(tokens))


def _rouge_tokens(c, stemmer):
    """Tokens, on the stems of a caller's stemmer; Porter's are made where pairs are compared."""
    t = rouge_tokens(c)
    return stem_tokens(t, stemmer) if stemmer not in (None, PORTER) else t


def rouge_n(df: DataFrame, id_cols: list[str], pred: str, ref: str, orders=(1, 2), stemmer=None) -> DataFrame:
    """X11: ROUGE-N precision / recall / F per pair and order (stemming optional)."""
    o = _overlap(df, id_cols, _rouge_tokens(pred, stemmer), _rouge_tokens(ref, stemmer), orders, stemmer == PORTER)
    rows = F.array(*[F.struct(F.lit(n).alias("n"), s.alias("s")) for n, s in zip(orders, _rouge_scores(o, orders))])
    return o.select(*id_cols, F.explode(rows).alias("x")).select(*id_cols, "x.n", "x.s.*")


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def rouge_l(df: DataFrame, id_cols: list[str], pred: str, ref: str, stemmer=None) -> DataFrame:
    """ROUGE-L precision / recall / F per pair (LCS on rouge tokens)."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    t = df.select(*id_cols, _rouge_tokens(pred, stemmer).alias("_p"), _rouge_tokens(ref, stemmer).alias("_r"))
    t = t.withColumn("_lcs", pair_figures(F.col("_p"), F.col("_r"), lcs=True, stemmed=stemmer == PORTER)["lcs"])
    return t.select(*id_cols, _prf(F.col("_lcs"), F.size("_p"), F.size("_r")).alias("s")).select(*id_cols, "s.*")


def rouge_scores(df: DataFrame, id_cols: list[str], pred: str, ref: str, stemmer=PORTER) -> DataFrame:
    """X11 + X12 in one pass: the F figures ``rouge1``, ``rouge2`` and ``rougeL`` of each pair, on stems by default."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    t = df.select(*id_cols, _rouge_tokens(pred, stemmer).alias("_p"), _rouge_tokens(ref, stemmer).alias("_r"))
    t = t.withColumn("_f", pair_figures(F.col("_p"), F.col("_r"), (1, 2), True, stemmer == PORTER))
    t = t.withColumns({"match": F.col("_f.match"), "_lcs": F.col("_f.lcs")})
    n_p, n_r = F.size("_p"), F.size("_r")
    return t.select(*id_cols, *[_prf(F.get("match", i), n_p - i, n_r - i)["fmeasure"].alias(f"rouge{i + 1}") for i in (0, 1)],
                    _prf(F.col("_lcs"), n_p, n_r)["fmeasure"].alias("rougeL"))


def _bleu_score(max_n: int, epsilon: float) -> Column:
    """Sentence BLEU from ``match`` (orders from 1), ``len_pred`` and ``len_ref``."""
    def log_p(m: Column, i: Column) -> Column:
        denom = F.greatest(F.col("len_pred") - i, F.lit(1))
        return F.log(F.when(m == 0, F.lit(epsilon) / denom).otherwise(m / denom)) / max_n
    logp = F.aggregate(F.transform("match", log_p), F.lit(0.0), lambda a, x: a + x)
    c, r = F.col("len_pred"), F.col("len_ref")
    bp = F.when(c > r, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - r / c))
    return F.when(F.get("match", 0) == 0, F.lit(0.0)).otherwise(bp * F.exp(logp))


def bleu(df: DataFrame, id_cols: list[str], pred: str, ref: str, max_n: int = 4, epsilon: float = 0.1) -> DataFrame:
    """Sentence BLEU, uniform weights up to 4-grams, smoothing method 1
    (``ε / denominator`` for zero numerators), brevity penalty; no unigram match
    -> 0.  Whitespace tokens."""
    o = _overlap(df, id_cols, words(pred), words(ref), range(1, max_n + 1))
    return o.select(*id_cols, F.col("len_pred").alias("c"), _bleu_score(max_n, epsilon).alias("bleu"))


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.round(x, digits)


def generation_metrics(df: DataFrame, id_cols: list[str], pred: str, ref: str, with_lcs: bool = True, with_bleu: bool = True,
                       rouge_digits: int | None = 4, bleu_digits: int | None = 2, stemmer=None) -> DataFrame:
    """Corpus means ×100 (BLEU over non-empty predictions), ``gen_len`` = mean
    words of the predictions; empty input -> zeros.  One row.

    ``rouge_digits`` / ``bleu_digits``: decimals of the figures, ``None`` leaves them
    unrounded.  Every score is row-local; the corpus row is the only aggregate."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    t = df.select(F.coalesce(word_count(pred), F.lit(0)).alias("_w"), _rouge_tokens(pred, stemmer).alias("_rp"), _rouge_tokens(ref, stemmer).alias("_rr"),
                  words(F.coalesce(to_col(pred), F.lit(""))).alias("_bp"), words(F.coalesce(to_col(ref), F.lit(""))).alias("_br"))
    rouge = t.withColumns({"_f": pair_figures(F.col("_rp"), F.col("_rr"), (1, 2), with_lcs, stemmer == PORTER),
                           "_bm": pair_figures(F.col("_bp"), F.col("_br"), (1, 2, 3, 4))["match"] if with_bleu else F.lit(None).cast("array<int>")})
    rouge = rouge.withColumns({"match": F.col("_f.match"), "_lcs": F.col("_f.lcs")})
    n_p, n_r = F.size("_rp"), F.size("_rr")
    s = rouge.select("_w", F.size("_bp").alias("len_pred"), F.size("_br").alias("len_ref"), F.col("_bm").alias("match"),
                     *[_prf(F.get("match", i), n_p - i, n_r - i)["fmeasure"].alias(f"rouge{i + 1}") for i in (0, 1)],
                     _prf(F.col("_lcs"), n_p, n_r)["fmeasure"].alias("rougeL"))
    mean = lambda x, times, digits: _rounded(F.coalesce(F.avg(x), F.lit(0.0)) * times, digits)
    out = [mean(F.col("rouge1"), 100, rouge_digits).alias("rouge1"), mean(F.col("rouge2"), 100, rouge_digits).alias("rouge2")]
    if with_lcs:
        out.append(mean(F.col("rougeL"), 100, rouge_digits).alias("rougeL"))
    out += [mean(F.col("_w"), 1, rouge_digits).alias("gen_len"), F.count("*").alias("n_pairs")]
    if with_bleu:
        out.append(mean(F.when(F.col("len_pred") > 0, _bleu_score(4, 0.1)), 100, bleu_digits).alias("bleu"))
    return s.agg(*out)


def pred_ref_join(preds: DataFrame, refs: DataFrame, id_cols: list[str]) -> DataFrame:
    """Predictions paired with references by an explicit id (never position)."""
    return preds.join(refs, id_cols)
