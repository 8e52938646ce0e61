"""Sentences at learned abbreviations (X2): an unsupervised learner and a native split.

The learner counts each word type of the corpus with and without a final period (one grouped
count) and scores it by the log-likelihood of "the period belongs to the word" against
"periods fall on words by chance" (Kiss and Strunk 2006): short types, types with inner periods and
types that never stand without their period score high. Types at or above the threshold are
abbreviations, and a period after one of them ends no sentence.

The split itself is an expression on the row: a set of literals looked up by hash as long as the
learned table is small, else each row's own abbreviations from a join on its types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.common import let, to_col
from corpuskit.functions.text import SENT_END, SENT_MARK, clean_text, keep_long_clean_sentences
from corpuskit.session import scratch_dir

# The threshold and the likelihood of the period after an abbreviation, as published.
THRESHOLD = 0.3
P_ABBREVIATION = 0.99
INLINE_BYTES = 2 << 20  # types up to this size travel inside the plan
TYPE = r"^\p{L}[\p{L}.]*$"


def _bare(token: Column) -> Column:
    """A token in lower case without what stands before its first letter and after its last letter or period."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), r"^[^\p{L}]+", ""), r"[^\p{L}.]+$", "")


def token_type(token) -> Column:
    """The word type of a token: bare, without its final period; an ellipsis is no final period."""
    return let(_bare(to_col(token)), lambda t: F.regexp_replace(t, r"\.+$", ""))


def period_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(type, n_with, n_without)``: how often each word type ends in one period and how often not.

    Equal tokens are counted first, so a type is read off once a token of the vocabulary."""
    t = df.select(F.explode(F.split(clean_text(text), " ")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).select(_bare(F.col("t")).alias("t"), "n")
    t = t.select("n", F.regexp_replace("t", r"\.+$", "").alias("type"), (F.endswith("t", F.lit(".")) & ~F.endswith("t", F.lit(".."))).alias("w"))
    return t.where(F.col("type").rlike(TYPE)).groupBy("type").agg(
        F.sum(F.when(F.col("w"), F.col("n")).otherwise(0)).alias("n_with"), F.sum(F.when(F.col("w"), 0).otherwise(F.col("n"))).alias("n_without"))


def abbreviation_score(n_with, n_without, type_, period_share) -> Column:
    """Log-likelihood ratio of the two hypotheses, weighted by the type's length, its inner periods and
    its occurrences without the period."""
    a, b = to_col(n_with).cast("double"), to_col(n_without).cast("double")
    letters = F.length(F.replace(to_col(type_), F.lit("."), F.lit(""))).cast("double")
    inner = F.length(type_).cast("double") - letters
    chance = a * F.log(period_share) + b * F.log(1 - period_share)
    owned = a * F.log(F.lit(P_ABBREVIATION)) + b * F.log(F.lit(1 - P_ABBREVIATION))
    return 2 * (owned - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters, -b)


def learn_abbreviations(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(type, n_with, n_without, score)`` of the corpus's abbreviations.

    The counts are written once; their totals and the scores read that table.  A corpus where no
    word, or every word, ends in a period has no abbreviations."""
    spark = df.sparkSession
    path = scratch_dir(spark, "period-counts") + "/table"
    period_counts(df, text).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.sum("n_with").alias("w"), F.sum("n_without").alias("o")).first()
    if not total["w"] or not total["o"]:
        return counts.where("false").withColumn("score", F.lit(0.0))
    share = F.lit(total["w"] / (total["w"] + total["o"]))
    return counts.where("n_with > 0").withColumn("score", abbreviation_score("n_with", "n_without", "type", share)).where(F.col("score") >= threshold)


def _joined_pieces(pieces: Column, is_abbreviation: Callable[[Column], Column]) -> Column:
    """Pieces of the plain split, with those that end in an abbreviation's period joined to the next."""
    def end(p: Column) -> Column:
        last = F.substring_index(p, " ", -1)
        open_ = F.endswith(last, F.lit(".")) & ~F.endswith(last, F.lit("..")) & is_abbreviation(token_type(last))
        return F.concat(p, F.when(F.coalesce(open_, F.lit(False)), F.lit(" ")).otherwise(F.lit(SENT_MARK)))
    firsts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), end)
    return F.split(F.concat(F.array_join(firsts, ""), F.element_at(pieces, -1)), SENT_MARK)


def plain_pieces(clean) -> Column:
    """The plain split of a cleaned text."""
    return F.split(F.regexp_replace(to_col(clean), f"{SENT_END} ", f"$1{SENT_MARK}"), SENT_MARK)


def split_sentences_at(clean, is_abbreviation: Callable[[Column], Column]) -> Column:
    """Sentences of a cleaned text; ``is_abbreviation`` tells of a word type whether its period is its own."""
    return let(plain_pieces(clean), lambda p: _joined_pieces(p, is_abbreviation))


def split_learned(df: DataFrame, abbreviations: DataFrame, text: str = "text", out: str = "sentences",
                  inline_bytes: int = INLINE_BYTES, plain: str | None = None) -> DataFrame:
    """``df`` with the sentences of its cleaned text, split by a learned table (column ``type``).

    ``plain`` names a column for the number of pieces of the plain split.

    A table of at most ``inline_bytes`` becomes a set of literals, searched by hash, and no row moves.
    A larger one meets the distinct types before a period of each text in a join by type, and the rows
    get their own abbreviations back by their text's digest."""
    size = abbreviations.agg(F.sum(F.octet_length("type") + 16)).first()[0] or 0
    if size <= inline_bytes:
        known = sorted(r["type"] for r in abbreviations.select("type").distinct().collect())
        # the pieces once, in their own projection: both columns read them
        cut = df.withColumn("_pieces", plain_pieces(clean_text(text)))
        cut = cut.withColumn(plain, F.size("_pieces")) if plain else cut
        return cut.withColumn(out, _joined_pieces(F.col("_pieces"), lambda t: t.isin(known) if known else F.lit(False))).drop("_pieces")
    keyed = df.withColumn("_clean", clean_text(text)).withColumn("_key", F.sha2("_clean", 256))
    ends = F.filter(F.split("_clean", " "), lambda t: F.endswith(t, F.lit(".")) & ~F.endswith(t, F.lit("..")))
    types = keyed.select("_key", F.explode(F.array_distinct(F.transform(ends, token_type))).alias("type")).distinct()
    own = (types.join(abbreviations.select("type").distinct(), "type").groupBy("_key").agg(F.collect_set("type").alias("_own"))
           .withColumnRenamed("_key", "_own_key"))
    both = keyed.join(own, F.col("_key") == F.col("_own_key"), "left")
    both = both.withColumn(plain, F.size(plain_pieces("_clean"))) if plain else both
    none = F.array().cast("array<string>")
    return (both.withColumn(out, let(F.coalesce("_own", none), lambda o: split_sentences_at(F.col("_clean"), lambda t: F.array_contains(o, t))))
            .drop("_clean", "_key", "_own", "_own_key"))


def learned_sentences(df: DataFrame, abbreviations: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """W3 with learned abbreviations: ``(doc_id, idx, sentence)`` of the sentences of more than ``min_words`` words."""
    s = split_learned(df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), abbreviations, "_text")
    return s.select("doc_id", F.posexplode(keep_long_clean_sentences("sentences", min_words)).alias("idx", "sentence"))
