"""Porter's stemmer (X13), with the extensions that ROUGE tools use by default.

A word is a string of letter kinds, consonant or vowel, and its measure is the number of vowel runs
that a consonant follows.  Each step looks for the longest suffix of its table and rewrites it if the
measure (or another condition) of what is left allows it.  ``stem_tokens`` applies it to token
arrays: every distinct word of an Arrow batch is stemmed once, and remembered by the task.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.common import to_col

# The suffix tables of Porter (1980), the irregular words and the two suffixes added since.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
             "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}
STEM_ABOVE = 3  # ROUGE stems words of more letters only


def kinds(word: str) -> str:
    """One letter a letter: ``v`` for a, e, i, o, u and a y after a consonant, else ``c``."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return kinds(stem).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    k = kinds(word)
    return k[-3:] == "cvc" and word[-1] not in "wxy" or k == "vc"


def _rewrite(word: str, table, allowed) -> str:
    """The longest suffix of the table that the word has decides; it changes only where ``allowed(stem, suffix)``."""
    for suffix, new in sorted(table, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            left = word[: len(word) - len(suffix)]
            return left + new if allowed(left, suffix) else word
    return word


def _past_and_ing(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        left = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in kinds(left):
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if left[-1:] == left[-2:-1] and kinds(left).endswith("c"):
                return left if left[-1] in "lsz" else left[:-1]
            return left + "e" if measure(left) == 1 and _short(left) else left
    return word


def _step_2(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]) > 0:
        return _step_2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    return _rewrite(word, STEP_2, lambda left, _: measure(left) > 0)


@lru_cache(maxsize=50_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _rewrite(word, STEP_1A, lambda left, _: True)
    word = _past_and_ing(word)
    if word.endswith("y") and len(word) > 2 and kinds(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    word = _rewrite(_step_2(word), STEP_3, lambda left, _: measure(left) > 0)
    word = _rewrite(word, [(s, "") for s in STEP_4], lambda left, s: measure(left) > 1 and (s != "ion" or left[-1:] in ("s", "t")))
    if word.endswith("e"):
        left = word[:-1]
        if measure(left) > 1 or measure(left) == 1 and not _short(left):
            word = left
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stems_of(words: pa.Array) -> pa.Array:
    """The stems of an array of words, those of more than three letters."""
    return pa.array([stem(w) if w is not None and len(w) > STEM_ABOVE else w for w in words.to_pylist()], pa.string())


def stem_tokens(tokens) -> Column:
    """An array of tokens with those of more than three letters stemmed; null stays an empty array."""
    active = SparkSession.getActiveSession()
    if active is not None:
        from corpuskit.session import ship_package
        ship_package(active)

    def run(batch: pa.Array) -> pa.Array:
        from corpuskit.functions import porter
        words = batch.flatten().dictionary_encode()
        stems = porter.stems_of(words.dictionary)
        sizes = pc.fill_null(pc.list_value_length(batch), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, stems.take(words.indices))
    return F.arrow_udf(run, "array<string>")(to_col(tokens))
