"""Scalar text functions as native Column expressions.

All of them compile to JVM expressions, so they stay inside whole-stage codegen
and run on whole texts without a Python round trip.  Regular expressions use
explicit character classes so that Spark (Java regex) and DuckDB (RE2) agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.common import let, to_col

# The whitespace that ``str.split`` knows, sentence terminators and marker text.
WS_CHARS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]"
SPACE = r"(?U:[\s\x1c-\x1f])"  # the same characters, as Java's engine tests them fastest
SENT_END = r"([.!?])"
SENT_MARK = "\u0001"
TRIMMED_SUFFIX = "... (trimmed)"
TRUNCATED_SUFFIX = "... (truncated)"
T5_PREFIX = "summarize: "


def strip_ws(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind
    (a character-set trim, no regular expression)."""
    return F.btrim(to_col(c), F.lit(WS_CHARS))


def rstrip_ws(c) -> Column:
    return F.rtrim(to_col(c), F.lit(WS_CHARS))


def lstrip_ws(c) -> Column:
    return F.ltrim(to_col(c), F.lit(WS_CHARS))


def clean_text(c) -> Column:
    """Runs of whitespace become one space; the result is stripped."""
    return F.trim(F.regexp_replace(to_col(c), f"{SPACE}+", " "))


def split_sentences(c) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by a space (language-free)."""
    return F.split(F.regexp_replace(to_col(c), f"{SENT_END} ", f"$1{SENT_MARK}"), SENT_MARK)


def split_sentences_ws(c) -> Column:
    """X2 for raw (not cleaned) text: any whitespace run after a terminator ends a
    sentence; the text is stripped first."""
    return F.split(F.regexp_replace(strip_ws(c), f"{SENT_END}{SPACE}+", f"$1{SENT_MARK}"), SENT_MARK)


def words(c) -> Column:
    """``str.split()`` as an array (empty array for blank text)."""
    return let(strip_ws(c), lambda s: F.when(s == "", F.array().cast("array<string>"))
               .otherwise(F.split(s, f"{SPACE}+")))


def word_count(c) -> Column:
    """``len(text.split())``; 0 for blank or null text."""
    return let(strip_ws(F.coalesce(to_col(c), F.lit(""))),
               lambda s: F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, f"{SPACE}+"))).cast("bigint"))


def keep_long_sentences(sentences, min_words: int = 5) -> Column:
    """Keep sentences with strictly more than ``min_words`` words."""
    return F.filter(to_col(sentences), lambda s: word_count(s) > F.lit(min_words))


def keep_long_clean_sentences(sentences, min_words: int = 5) -> Column:
    """X3 for sentences of *cleaned* text (single spaces, no edge blanks): the word
    count is the number of single-space separated pieces — a cheap split."""
    return F.filter(to_col(sentences),
                    lambda s: (s != "") & (F.size(F.split(s, " ")) > F.lit(min_words)))


def rfind(c, needle: str) -> Column:
    """0-based index of the last occurrence of ``needle``, or -1."""
    c = to_col(c)
    return let(F.locate(needle[::-1], F.reverse(c)), lambda pos: F.when(pos == 0, F.lit(-1)).otherwise(
        F.length(c) - pos + 1 - F.lit(len(needle))).cast("bigint"))


def safe_text(c) -> Column:
    """P5: null becomes the empty string; any other value its string form."""
    return F.coalesce(to_col(c).cast("string"), F.lit(""))


def model_prefix(text, model_id: str) -> Column:
    """Prepend the T5 task prefix when the model id names a T5 model."""
    if "t5" in model_id.lower():
        return F.concat(F.lit(T5_PREFIX), to_col(text))
    return to_col(text)


def preview(c, n: int = 500) -> Column:
    """First ``n`` characters plus a marker when the text is longer."""
    c = to_col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(TRUNCATED_SUFFIX))).otherwise(c)


def starts_with_point(c) -> Column:
    """The stripped line starts with ``1.`` .. ``9.``."""
    return F.substring(lstrip_ws(c), 1, 2).rlike(r"^[1-9]\.$")


def mask_padding(c, pad: int = 0, ignore: int = -100) -> Column:
    """Pad id -> -100 (loss ignore index)."""
    return F.transform(to_col(c), lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def unmask_padding(c, pad: int = 0, ignore: int = -100) -> Column:
    """-100 -> pad id before decoding."""
    return F.transform(to_col(c), lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))


def lower_tokens(c) -> Column:
    """X4 tokens: lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(to_col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def rouge_tokens(c) -> Column:
    """X11 tokens: lower-case, anything but ``[a-z0-9]`` separates tokens."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(to_col(c), F.lit(""))), "[^a-z0-9]+", " "))
    return let(s, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))
