"""Fixed-length encoding (X9) — the re-aimed tokenizer step.

Words (lower-cased runs of word characters) map to ids by hashing into a fixed
vocabulary, so encoding is a stateless per-row projection: no vocabulary build,
no shuffle, no broadcast that grows with the corpus.  Ids 0 and 1 are reserved
(padding, unused), as in common tokenizers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.common import let, to_col
from corpuskit.functions.text import lower_tokens

# Vocabulary size, reserved ids and the padding id.
DEFAULT_VOCAB = 30000
RESERVED = 2
PAD_ID = 0


def token_id(tok: Column, vocab: int = DEFAULT_VOCAB) -> Column:
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return (h % (vocab - RESERVED) + RESERVED).cast("int")


def _padded_ids(toks: Column, length: int, vocab: int) -> Column:
    return let(F.transform(toks, lambda t: token_id(t, vocab)), lambda ids: F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(length) - F.size(ids))))


def _mask(toks: Column, length: int) -> Column:
    return let(F.size(toks), lambda k: F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(length) - k)))


def _tokens(text, length: int) -> Column:
    return F.slice(lower_tokens(to_col(text)), 1, length)


def encode_ids(text, length: int, vocab: int = DEFAULT_VOCAB) -> Column:
    """Token ids truncated / padded to ``length``."""
    return let(_tokens(text, length), lambda t: _padded_ids(t, length, vocab))


def attention_mask(text, length: int) -> Column:
    return let(_tokens(text, length), lambda t: _mask(t, length))


def encode_fixed_length(df: DataFrame, text: str, length: int, vocab: int = DEFAULT_VOCAB) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of constant length, from one tokenisation.  Ids are hash
    buckets, so no vocabulary is needed; ``vocabulary.py`` has ids by corpus frequency."""
    both = let(_tokens(text, length), lambda t: F.struct(_padded_ids(t, length, vocab).alias("i"), _mask(t, length).alias("m")))
    return df.withColumn("_both", both).withColumns({"input_ids": F.col("_both.i"), "attention_mask": F.col("_both.m")}).drop("_both")
