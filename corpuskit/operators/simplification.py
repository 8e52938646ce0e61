"""How good a simplification is: SARI, meaning preservation and readability.

SARI and readability are row-local.  Meaning preservation weighs words by their rarity in the
whole corpus: the document frequencies are a table keyed by term, joined by term, so nothing but counts moves.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.common import let, to_col
from corpuskit.functions.text import clean_text, lower_tokens, split_sentences, words
from corpuskit.session import scratch_dir, ship_package

MAX_N = 4
# The letters that make syllables, and the coefficients of the two Flesch figures.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
EASE = (206.835, 1.015, 84.6)
GRADE = (0.39, 11.8, 15.59)


# -- SARI ---------------------------------------------------------------------

def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[i:] for i in range(n)]))


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 1.0


def sari_counts(source: list[str], output: list[str], references: list[list[str]], n: int) -> list[float]:
    """Precision and recall of what was added and kept, and precision of what was deleted, for n-grams
    (Xu et al. 2016): reference counts are means over the references; nothing to do and nothing done is 1."""
    s, o = _grams(source, n), _grams(output, n)
    r = Counter()
    for ref in references:
        r.update(_grams(ref, n))
    mean = {g: c / len(references) for g, c in r.items()}
    added, wanted = [g for g in o if g not in s], [g for g in r if g not in s]
    good = sum(1 for g in added if g in r)
    kept = {g: min(c, o[g]) for g, c in s.items() if g in o}
    keep = {g: min(c, mean[g]) for g, c in s.items() if g in mean}
    both = sum(min(c, keep[g]) for g, c in kept.items() if g in keep)
    gone = {g: c - o[g] for g, c in s.items() if c > o[g]}
    rid = sum(min(c, max(0.0, s[g] - mean.get(g, 0.0))) for g, c in gone.items())
    return [_share(good, len(added)), _share(good, len(wanted)), _share(both, sum(kept.values())), _share(both, sum(keep.values())), _share(rid, sum(gone.values()))]


def sari(df: DataFrame, source: str, output: str, references: str, out: str = "sari") -> DataFrame:
    """``df`` with the SARI of ``output`` (0 to 100): the mean of the F figures of added and kept n-grams and of the
    precision of deleted ones, each averaged over 1- to 4-grams of lower-cased words.  ``references`` is an
    array of texts; rows without a reference get null; null texts are empty."""
    ship_package(df.sparkSession)
    text = lambda c: words(F.lower(F.coalesce(c, F.lit(""))))

    def run(s: pd.Series, o: pd.Series, r: pd.Series) -> pd.Series:
        rows = []
        for a, b, refs in zip(s, o, r):
            rows.append([sum(x) / MAX_N for x in zip(*[sari_counts(list(a), list(b), [list(t) for t in refs], n + 1) for n in range(MAX_N)])]
                        if refs is not None and len(refs) else None)
        return pd.Series(rows, dtype=object)

    parts = F.pandas_udf(run, "array<double>")(text(to_col(source)), text(to_col(output)), F.transform(references, text))
    f = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    x = [F.get("_parts", i) for i in range(5)]
    score = F.when(F.col("_parts").isNotNull(), 100 * (f(x[0], x[1]) + f(x[2], x[3]) + x[4]) / 3)
    return df.withColumn("_parts", parts).withColumn(out, score).drop("_parts")


# -- meaning --------------------------------------------------------------------

def pair_terms(df: DataFrame, id_cols: list[str], original: str, simplified: str) -> DataFrame:
    """``(ids, term, tf_a, tf_b)``: how often each term stands in the two texts of a pair."""
    side = lambda c, a, b: F.transform(F.coalesce(lower_tokens(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    t = df.select(*id_cols, F.explode(F.concat(side(original, 1, 0), side(simplified, 0, 1))).alias("t"))
    return t.groupBy(*id_cols, "t.term").agg(F.sum("t.a").alias("tf_a"), F.sum("t.b").alias("tf_b"))


def term_idf(terms: DataFrame, n_texts: int) -> DataFrame:
    """``(term, df, idf)`` over all texts of the pairs: ``ln((1 + n) / (1 + df)) + 1``."""
    there = (F.col("tf_a") > 0).cast("long") + (F.col("tf_b") > 0).cast("long")
    d = terms.groupBy("term").agg(F.sum(there).alias("df"))
    return d.withColumn("idf", F.log((F.lit(1.0) + n_texts) / (1 + F.col("df"))) + 1)


def meaning_preservation(df: DataFrame, id_cols: list[str], original: str, simplified: str) -> DataFrame:
    """``(ids, meaning)``: the cosine of the TF-IDF vectors of a text and its simplification, with the rarity of the
    terms in the whole corpus of pairs; 0 where one of them has no term.  Pairs must have ids of their own."""
    spark = df.sparkSession
    path = scratch_dir(spark, "pair-terms") + "/table"
    pair_terms(df, id_cols, original, simplified).write.parquet(path)
    terms = spark.read.parquet(path)
    idf = term_idf(terms, 2 * df.count())
    w = terms.join(idf.select("term", "idf"), "term")
    a, b = F.col("tf_a") * F.col("idf"), F.col("tf_b") * F.col("idf")
    s = w.groupBy(*id_cols).agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    cosine = s.select(*id_cols, F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("meaning"))
    return df.select(*id_cols).join(cosine, id_cols, "left").withColumn("meaning", F.coalesce("meaning", F.lit(0.0)))


# -- readability --------------------------------------------------------------

def _spaced(text: Column) -> Column:
    """The words of a text in lower case, each between two spaces of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit(" "))


def syllable_pattern_counts(spaced: Column) -> Column:
    """Syllables of spaced words: vowel groups, less a silent final e that is not the only one and not of an -le, and one
    for a word without vowels."""
    groups = F.regexp_count(spaced, F.lit(f"[{VOWELS}]+"))
    silent = F.regexp_count(spaced, F.lit(f" [^ ]*[{VOWELS}][^ ]*[^{VOWELS}l ]e "))
    none = F.regexp_count(spaced, F.lit(f" [^{VOWELS} ]+ "))
    return (groups - silent + none).cast("long")


def readability_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_sentences``, ``n_words`` (runs of letters) and ``n_syllables`` of its texts."""
    spaced = let(_spaced(F.coalesce(to_col(text), F.lit(""))), lambda s: F.struct(F.regexp_count(s, F.lit(r" \p{L}+ ")).cast("long").alias("w"), syllable_pattern_counts(s).alias("s")))
    sentences = F.size(F.filter(split_sentences(clean_text(F.coalesce(to_col(text), F.lit("")))), lambda s: s != "")).cast("long")
    return df.withColumn("_c", spaced).withColumns({"n_sentences": sentences, "n_words": F.col("_c.w"), "n_syllables": F.col("_c.s")}).drop("_c")


def flesch(n_sentences: Column, n_words: Column, n_syllables: Column) -> tuple[Column, Column]:
    """Reading ease and grade; null without words."""
    w, s = n_words / F.greatest(n_sentences, F.lit(1)), n_syllables / n_words
    there = n_words > 0
    return (F.when(there, EASE[0] - EASE[1] * w - EASE[2] * s), F.when(there, GRADE[0] * w + GRADE[1] * s - GRADE[2]))


def readability(df: DataFrame, text: str = "text", group: list[str] | None = None) -> DataFrame:
    """Counts, Flesch reading ease and Flesch-Kincaid grade of every row, or of every group from its summed counts."""
    c = readability_counts(df, text)
    if group is not None:
        c = c.groupBy(*group).agg(F.count("*").alias("n_texts"), *[F.sum(k).alias(k) for k in ("n_sentences", "n_words", "n_syllables")])
    ease, grade = flesch(F.col("n_sentences"), F.col("n_words"), F.col("n_syllables"))
    return c.withColumns({"reading_ease": ease, "grade": grade})
