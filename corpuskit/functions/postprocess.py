"""Summary post-processing (X7, X8, W5) as higher-order Column expressions.

The text is split into its line array once; renumbering, the truncation rules and
the final strip are array / string expressions evaluated per row on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.common import let, to_col
from corpuskit.functions.text import (lstrip_ws, rfind, rstrip_ws, split_sentences_ws, starts_with_point,
                                      strip_ws, word_count)

# The line tag used by the summarizer output, cut-off fractions and
# the completion suffixes.
LINE_TAG = "<n>"
PERIOD_CUT = 0.7
COMMA_CUT = 0.8
CONJ_CUT = 0.8
CONJUNCTIONS = (" and ", " but ", " or ")
COMMA_SUFFIX = " etc."
CONJ_SUFFIX = "."
ELLIPSIS_SUFFIX = "..."


def _is_point(line: Column) -> Column:
    # stripped first char is a digit and ". " occurs within the first 5 raw chars
    return F.substring(lstrip_ws(line), 1, 1).rlike(r"^\p{Nd}$") & (F.locate(". ", F.substring(line, 1, 5)) > 0)


def renumber_points(lines) -> Column:
    """Drop blank lines; numbered lines are renumbered 1, 2, ... in order.

    O(n log n) per text: numbered lines get their rank from their position in
    the filtered array, then both kinds are merged back by original index with
    one ``array_sort`` (no per-line prefix scan)."""
    def body(kept):
        tagged = F.transform(kept, lambda l, i: F.struct(i.alias("i"), _is_point(l).alias("f"), l.alias("line")))

        def on_tagged(tg):
            nums = F.transform(F.filter(tg, lambda t: t["f"]), lambda t, j: F.struct(
                t["i"].alias("i"), F.concat((j + 1).cast("string"), F.lit(". "),
                                            F.substring(t["line"], F.locate(". ", t["line"]) + 2, 1 << 30)).alias("line")))
            others = F.transform(F.filter(tg, lambda t: ~t["f"]),
                                 lambda t: F.struct(t["i"].alias("i"), t["line"].alias("line")))
            return F.transform(F.array_sort(F.concat(nums, others)), lambda t: t["line"])
        return let(tagged, on_tagged)
    return let(F.filter(to_col(lines), lambda l: strip_ws(l) != ""), body)


def _rfind_rev(text: Column, rev: Column, needle: str) -> Column:
    """``rfind`` on a text whose reverse is already bound."""
    pos = F.locate(needle[::-1], rev)
    return F.when(pos == 0, F.lit(-1)).otherwise(F.length(text) - pos + 1 - F.lit(len(needle)))


def _ends_open(text: Column) -> Column:
    return (text != "") & ~F.substring(rstrip_ws(text), -1, 1).isin(".", "?", "!")


def _last_terminator(text: Column) -> Column:
    return F.greatest(rfind(text, "."), rfind(text, "?"), rfind(text, "!"))


def _complete(points: Column) -> Column:
    def body(pts):
        def on_text(text):
            def on_rev(rev):
                n = F.length(text)
                last_point = F.coalesce(F.try_element_at(pts, F.lit(-1)), F.lit(""))
                lp = F.greatest(*[_rfind_rev(text, rev, c) for c in (".", "?", "!")])
                lc = _rfind_rev(text, rev, ",")
                lconj = F.greatest(*[_rfind_rev(text, rev, w) for w in CONJUNCTIONS])
                cut = (F.when(lp > n * PERIOD_CUT, F.substring(text, 1, lp + 1))
                       .when(lc > n * COMMA_CUT, F.concat(F.substring(text, 1, lc + 1), F.lit(COMMA_SUFFIX)))
                       .when(lconj > n * CONJ_CUT, F.concat(F.substring(text, 1, lconj), F.lit(CONJ_SUFFIX)))
                       .otherwise(F.concat(rstrip_ws(text), F.lit(ELLIPSIS_SUFFIX))))
                short = F.when(F.size(pts) > 1, F.array_join(
                    F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), "\n")).otherwise(text)
                return (F.when(~_ends_open(text), text)
                        .when(word_count(last_point) < 3, short)
                        .otherwise(cut))
            return let(F.reverse(text), on_rev)
        return let(F.array_join(pts, "\n"), on_text)
    return let(points, body)


def post_process_summary(c) -> Column:
    """Inference-time clean-up of a generated summary."""
    def body(text):
        lines = F.split(text, "\n")

        def on_sentences(sentences):
            any_point = F.exists(lines, lambda l: starts_with_point(l))
            as_points = F.array_join(
                F.transform(sentences, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
            return F.when(~any_point & (F.size(sentences) > 1), as_points).otherwise(
                strip_ws(_complete(renumber_points(lines))))
        return let(split_sentences_ws(text), on_sentences)
    return let(F.replace(to_col(c), F.lit(LINE_TAG), F.lit("\n")), body)


def post_process_training(c) -> Column:
    """Training-time variant — renumber, then cut at the last terminator if it
    lies beyond 70 % of the text; no tag replacement, no suffixes."""
    def on_text(text):
        lp = _last_terminator(text)
        cut = F.when(_ends_open(text) & (lp > F.length(text) * PERIOD_CUT),
                     F.substring(text, 1, lp + 1)).otherwise(text)
        return strip_ws(cut)
    return let(F.array_join(renumber_points(F.split(to_col(c), "\n")), "\n"), on_text)
