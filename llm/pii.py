"""Personal data: spans proposed by regular expressions, confirmed by checksums, scored by context.

Method: each kind's expression proposes spans (leftmost, not overlapping); validators
confirm them (Luhn for cards, mod-97 for account numbers, part and digit bounds); the
words around a span raise its score. Kinds in ``BASE`` count as soon as they are
confirmed; the method's own kinds (``MORE``) need a score of ``ACCEPT``, which some reach
by their checksum and the others only with a fitting context word.

Everything is DataFrame expressions. A text is cut once per kind, at the matches; the
lengths of the cut pieces give the spans' code points, the pieces and matches around a
span its context: ``CONTEXT`` code points on each side, whatever stands there. ``redact``
replaces the spans that ``find`` accepts, found in the text as it is. The expressions equal the plain ones given for each kind, written with
possessive quantifiers and a look at the character before, so that long runs of digits
or letters cost linear time and no stack.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows
and null ids are rows of their own; other columns are not read (``find``) or are kept
(``redact``); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.common import let

ACCEPT = 0.5
CONTEXT = 40  # code points on each side
_MAIL = "A-Za-z0-9._%+-"

#: kind -> (a character every match has, or None; expression)
BASE = {
    "email": ("@", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    "card": (None, r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
MORE = {
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": (None, r"(?i)(?<![a-z0-9])(?:token|secret|password|api[_-]?key)[\"']?\x20{0,4}[=:]\x20{0,4}[\"'][a-z0-9+/_=-]{16,512}[\"']"),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (None, r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
}
#: kind -> (score of a confirmed span, context words that add CONTEXT_SCORE)
SCORES = {
    "email": (0.9, "mail|contact|write"), "ip": (0.6, "ip|host|server|address"), "card": (0.8, "card|visa|payment|credit"),
    "phone": (0.7, "phone|tel|call|fax|mobile"), "iban": (0.8, "iban|account|bank"), "secret": (0.8, "key|auth"),
    "ssn": (0.3, "ssn|social security"), "local_phone": (0.2, "phone|tel|call|fax|mobile"),
}
CONTEXT_SCORE = 0.4
_BLOCK = 256
_PARTS = CONTEXT + 1  # pieces and matches in turn, matches of two characters at least: never less than the context


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of at most 19 digits."""
    rev = F.reverse(digits)

    def one(i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """The mod-97 checksum of an account number (letters count from 10)."""
    s = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + (c - 55)) % 97).otherwise((acc * 10 + (c - 48)) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.size(F.filter(F.split(m, r"\."), lambda part: ~part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))) == 0
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.lit(True)


def _running(values: Column, op=lambda acc, x: acc + x) -> Column:
    """Sums (or another fold from 0) of all earlier elements, for each element, in blocks so that long arrays stay cheap."""
    def ends(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    return let(_blocks(values), lambda bs: F.flatten(F.zip_with(
        bs, F.slice(ends(F.transform(bs, lambda s: F.aggregate(s, F.lit(0), op)), F.lit(0)), F.lit(1), F.size(bs)),
        lambda s, start: F.slice(ends(s, start), F.lit(1), F.size(s)))))


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")


def _cut(text: Column, kind: str, fn, empty: Column) -> Column:
    """``fn(pieces, matches)`` of a text that holds a match, ``empty`` otherwise."""
    sure, rx = (BASE | MORE)[kind]
    found = let(F.regexp_extract_all(text, F.lit(rx), F.lit(0)),
                lambda ms: F.when(F.size(ms) > 0, let(F.split(text, rx, -1), lambda ps: fn(ps, ms))).otherwise(empty))
    return F.when(text.contains(sure), found).otherwise(empty) if sure else found


def _score(kind: str, tails: Column, heads: Column, i: Column) -> Column:
    """The score of match ``i`` of a text cut into pieces and matches in turn, from the parts' last and first ``CONTEXT`` code points."""
    own, words = SCORES[kind]
    at = i * 2 + 1  # parts before the match
    before = F.right(F.array_join(F.slice(tails, F.greatest(at - _PARTS, F.lit(0)) + 1, F.least(at, F.lit(_PARTS))), ""), F.lit(CONTEXT))
    after = F.left(F.array_join(F.slice(heads, at + 2, F.lit(_PARTS)), ""), F.lit(CONTEXT))
    near = F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"(?<![a-z])(?:{words})")
    return F.lit(own) + F.when(near, CONTEXT_SCORE).otherwise(0.0)


def spans(text: Column, kind: str) -> Column:
    """Accepted spans of one kind, in order: kind, start, end (code points, end exclusive), score."""
    def build(ps: Column, ms: Column) -> Column:
        def placed(held: Column, parts: Column) -> Column:
            def scored(at: Column, tails: Column, heads: Column) -> Column:
                out = F.transform(held, lambda s: F.struct(
                    F.lit(kind).alias("kind"), F.get(at, s["i"] * 2 + 1).alias("start"), (F.get(at, s["i"] * 2 + 1) + F.length(s["m"])).alias("end"),
                    _score(kind, tails, heads, s["i"]).alias("score")))
                return out if kind in BASE else F.filter(out, lambda s: s["score"] >= ACCEPT)
            return let(let(F.transform(parts, lambda x: F.length(x)), lambda x: _running(x)), lambda at: let(
                F.transform(parts, lambda x: F.right(x, F.lit(CONTEXT))), lambda tails: let(
                    F.transform(parts, lambda x: F.left(x, F.lit(CONTEXT))), lambda heads: scored(at, tails, heads))))
        parts = F.concat(F.flatten(F.transform(ms, lambda m, i: F.array(F.get(ps, i), m))), F.array(F.element_at(ps, -1)))
        return let(F.filter(F.transform(ms, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda s: _confirmed(kind, s["m"])),
                   lambda held: F.when(F.size(held) > 0, let(parts, lambda x: placed(held, x))).otherwise(_none()))
    return _cut(text, kind, build, _none())


def _clear(own: Column, base: Column) -> Column:
    """The spans of ``own`` that meet none of ``base``."""
    return F.filter(own, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, more)`` for each row: arrays of spans by kind as listed, then start.
    A span of ``MORE`` that meets one of ``BASE`` is left to the latter."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", *[spans(F.col("text"), k).alias(k) for k in (BASE | MORE)])
    df = df.select("doc_id", *BASE, F.concat(*BASE).alias("base"), F.concat(*MORE).alias("own"))
    return df.select("doc_id", *BASE, "base", _clear(F.col("own"), F.col("base")).alias("more"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, found: Column) -> Column:
    """``text`` with the spans replaced; spans that meet count as one of the kind listed first."""
    kinds = F.array(*[F.lit(k) for k in (BASE | MORE)])

    def merged(o: Column, before: Column, first: Column) -> Column:
        def one(at: Column, c: Column) -> Column:
            after = F.coalesce(F.get(first, c + 1), F.size(o))
            return F.struct(F.get(before, at).alias("from"), F.get(o, at)["start"].alias("start"),
                            F.coalesce(F.get(before, after), F.array_max(F.transform(o, lambda s: s["end"]))).alias("end"),
                            F.array_min(F.transform(F.slice(o, at + 1, after - at), lambda s: s["rank"])).alias("rank"))
        return F.transform(first, one)

    def put(block: Column) -> Column:
        # a block's text is cut out once, so that long texts with many spans stay cheap
        start = F.get(block, 0)["from"]
        cut = F.substring(text, start + 1, F.element_at(block, -1)["end"] - start)
        return let(cut, lambda t: F.array_join(F.transform(block, lambda s: F.concat(
            F.substring(t, s["from"] - start + 1, s["start"] - s["from"]), F.lit("["), F.upper(F.get(kinds, s["rank"] - 1)), F.lit("]"))), ""))

    ordered = F.sort_array(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.array_position(kinds, s["kind"]).cast("int").alias("rank"))))
    whole = let(ordered, lambda o: let(_running(F.transform(o, lambda s: s["end"]), lambda acc, x: F.greatest(acc, x)), lambda before: let(
        F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.get(o, i)["start"] >= F.get(before, i)), lambda first: merged(o, before, first))))
    return let(whole, lambda w: F.concat(F.array_join(F.transform(_blocks(w), put), ""), F.substring(text, F.element_at(w, -1)["end"] + 1, F.length(text))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find`` accepts replaced by its kind in brackets (spans
    that meet by one, the kind listed first); a null text stays null, all other columns are kept."""
    text = F.col(text_col).cast("string")
    base, own = (F.concat(*[spans(text, k) for k in kinds]) for kinds in (BASE, MORE))
    out = let(base, lambda b: let(F.concat(b, _clear(own, b)), lambda found: F.when(F.size(found) > 0, _replaced(text, found)).otherwise(text)))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), out))
