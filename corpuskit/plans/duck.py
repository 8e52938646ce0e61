"""DuckDB SQL fragments mirroring the Column expressions of ``corpuskit.functions``.

Only used to write the oracle SQL of the query catalog: each helper returns the
SQL text of the same rule, so the oracle and the Spark plan share one definition
of every text rule without sharing an engine.
"""

from __future__ import annotations

from corpuskit.functions.text import WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def clean_text(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def split_sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


def split_sentences_ws(x: str) -> str:
    return f"string_split(regexp_replace({strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def word_count(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '{WS}+')) END)"


def words(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


def keep_long_sentences(arr: str, min_words: int = 5) -> str:
    return f"list_filter({arr}, lambda s: {word_count('s')} > {min_words})"


def rfind(x: str, needle: str) -> str:
    rn = needle[::-1].replace("'", "''")
    p = f"strpos(reverse({x}), '{rn}')"
    return f"(CASE WHEN {p} = 0 THEN -1 ELSE length({x}) - {p} + 1 - {len(needle)} END)"


def preview(x: str, n: int = 500) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '... (truncated)' ELSE {x} END)"


def starts_with_point(x: str) -> str:
    return f"regexp_matches({strip(x)}, '^[1-9]\\.')"


def lower_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def rouge_tokens(x: str) -> str:
    s = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


def _is_point(l: str) -> str:
    return f"(regexp_matches({strip(l)}, '^\\p{{Nd}}') AND strpos(left({l}, 5), '. ') > 0)"


def renumber_points(lines: str) -> str:
    kept = f"list_filter({lines}, lambda l: {strip('l')} <> '')"
    flags = f"list_transform({kept}, lambda l: {_is_point('l')})"
    k = f"len(list_filter({flags}[1:i], lambda f: f))"
    after = "substr(line, strpos(line, '. ') + 2)"
    return (f"list_transform({kept}, lambda line, i: CASE WHEN {flags}[i] "
            f"THEN {k}::VARCHAR || '. ' || {after} ELSE line END)")


def _ends_open(t: str) -> str:
    return f"({t} <> '' AND right({rstrip(t)}, 1) NOT IN ('.', '?', '!'))"


def _last_terminator(t: str) -> str:
    return f"greatest({rfind(t, '.')}, {rfind(t, '?')}, {rfind(t, '!')})"


def complete(points: str) -> str:
    t = f"array_to_string({points}, chr(10))"
    n = f"length({t})"
    last_point = f"coalesce({points}[-1], '')"
    lp = _last_terminator(t)
    lc = rfind(t, ",")
    lconj = f"greatest({rfind(t, ' and ')}, {rfind(t, ' but ')}, {rfind(t, ' or ')})"
    cut = (f"CASE WHEN {lp} > {n} * 0.7 THEN left({t}, {lp} + 1) "
           f"WHEN {lc} > {n} * 0.8 THEN left({t}, {lc} + 1) || ' etc.' "
           f"WHEN {lconj} > {n} * 0.8 THEN left({t}, {lconj}) || '.' "
           f"ELSE {rstrip(t)} || '...' END")
    short = (f"CASE WHEN len({points}) > 1 THEN array_to_string({points}[1:len({points}) - 1], chr(10)) "
             f"ELSE {t} END")
    return (f"(CASE WHEN NOT {_ends_open(t)} THEN {t} WHEN {word_count(last_point)} < 3 THEN {short} "
            f"ELSE {cut} END)")


def post_process_summary(x: str) -> str:
    text = f"replace({x}, '<n>', chr(10))"
    lines = f"string_split({text}, chr(10))"
    any_point = f"len(list_filter({lines}, lambda l: {starts_with_point('l')})) > 0"
    sents = split_sentences_ws(text)
    as_points = f"array_to_string(list_transform({sents}, lambda s, i: i::VARCHAR || '. ' || s), chr(10))"
    fixed = strip(complete(renumber_points(lines)))
    return f"(CASE WHEN NOT ({any_point}) AND len({sents}) > 1 THEN {as_points} ELSE {fixed} END)"


def post_process_training(x: str) -> str:
    pts = renumber_points(f"string_split({x}, chr(10))")
    t = f"array_to_string({pts}, chr(10))"
    lp = _last_terminator(t)
    return strip(f"(CASE WHEN {_ends_open(t)} AND {lp} > length({t}) * 0.7 THEN left({t}, {lp} + 1) ELSE {t} END)")


def points_text(text="text", id_col="doc_id") -> str:
    a = split_sentences(clean_text(text))
    numbered = (f"CASE WHEN {id_col} % 2 = 0 THEN list_transform({a}, lambda z, k: k::VARCHAR || '. ' || z) "
                f"ELSE {a} END")
    j = f"array_to_string({numbered}, '<n>')"
    return f"(CASE WHEN {id_col} % 3 = 0 AND ends_with({j}, '.') THEN left({j}, length({j}) - 1) ELSE {j} END)"
