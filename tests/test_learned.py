"""Abbreviations, the frequency vocabulary and stems, on texts whose results are known."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import porter
from corpuskit.operators import abbreviations as A
from corpuskit.operators import vocabulary as V

LEGAL = ["See Roe v. Wade for the rule. The court in Doe v. Smith agreed. It cited No. 12 of the U.S. Code.",
         "Under No. 7 the claim fails. Jones v. Brown holds otherwise. The U.S. Senate and the U.S. House met.",
         "He paid the fee to Acme Inc. and left. Acme Inc. sued under U.S. law. Is it so? Yes! See No. 9."]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _corpus(spark):
    plain = "The judge read the claim and the rule. The claim was no good and the fee was paid. The senate left the house and the court met. Law and code say so, as the rule says it. All who met there read the code and the law first. "
    return _docs(spark, LEGAL * 10 + [plain * 5] * 10)


def test_learned_abbreviations_of_legal_texts(spark):
    found = {r.type: r.score for r in A.learn_abbreviations(_corpus(spark)).collect()}
    assert {"v", "u.s", "inc"} <= set(found) and found["u.s"] > found["inc"]
    assert not set(found) & {"rule", "claim", "fee", "law", "house", "paid", "met", "court", "no"}  # "no" stands without a period too
    assert A.learn_abbreviations(_docs(spark, ["no period here", None, ""])).count() == 0
    assert A.learn_abbreviations(_docs(spark, ["all. of. them."])).count() == 0
    assert A.learn_abbreviations(_docs(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("inline", [1 << 20, 0])
def test_split_at_learned_abbreviations(spark, inline):
    """The set of literals and the join split alike."""
    known = spark.createDataFrame([("v",), ("no",), ("u.s",), ("inc",)], "type string")
    texts = LEGAL + [None, "", "v. v. v.", "Wait... No. Go on.", "(No. 5) is here. \"Inc.\" is not. Plain end", "one two"] + LEGAL[:1]
    got = {r.doc_id: r.sentences for r in A.split_learned(_docs(spark, texts), known, inline_bytes=inline).collect()}
    assert got[0] == ["See Roe v. Wade for the rule.", "The court in Doe v. Smith agreed.", "It cited No. 12 of the U.S. Code."] == got[9]
    assert got[2] == ["He paid the fee to Acme Inc. and left.", "Acme Inc. sued under U.S. law.", "Is it so?", "Yes!", "See No. 9."]
    assert got[3] is None and got[4] == [""] and got[5] == ["v. v. v."]
    assert got[6] == ["Wait...", "No. Go on."]  # an ellipsis is no abbreviation's period
    assert got[7] == ["(No. 5) is here.", "\"Inc.\" is not.", "Plain end"]
    rows = A.learned_sentences(_docs(spark, LEGAL[:1]), known).collect()
    assert [(r.idx, r.sentence[:8]) for r in rows] == [(0, "See Roe "), (1, "The cour"), (2, "It cited")]


def test_long_text_splits_whole(spark):
    text = "Roe v. Wade is cited here once more. " * 20_000
    known = spark.createDataFrame([("v",)], "type string")
    assert A.split_learned(_docs(spark, [text]), known).select(F.size("sentences")).first()[0] == 20_000


def test_vocabulary_ids_are_dense_and_by_frequency(spark):
    random.seed(3)
    texts = [" ".join(random.choice(["the", "of", "court"] + [f"w{i}" for i in range(300)]) for _ in range(100)) for _ in range(40)] + [None, "", "a ?"]
    v = {r.token: (r.n, r.token_id) for r in V.build_vocabulary(_docs(spark, texts).repartition(7), size=None).collect()}
    plain = Counter(t for x in texts for t in (x or "").split() if len(t) > 1)
    assert {t: n for t, (n, _) in v.items()} == dict(plain)
    assert [t for t, _ in sorted(v.items(), key=lambda x: x[1][1])] == sorted(plain, key=lambda t: (-plain[t], t))
    assert sorted(i for _, i in v.values()) == list(range(V.FIRST_ID, V.FIRST_ID + len(plain)))  # ties of one frequency are numbered too
    small = V.build_vocabulary(_docs(spark, texts), size=12)
    assert small.count() == 10 and small.agg(F.max("token_id")).first()[0] == 11
    assert V.build_vocabulary(_docs(spark, texts), min_count=10**6).count() == 0


def test_encoding_by_the_vocabulary(spark):
    v = spark.createDataFrame([("law", 5, 2), ("court", 4, 3)], "token string, n long, token_id long")
    docs = _docs(spark, ["Law of the COURT", None, "", "law " * 50])
    got = {r.doc_id: (r.input_ids, r.attention_mask) for r in V.encode_with_vocabulary(docs, v, "text", 6).collect()}
    assert got[0] == ([2, 1, 1, 3, 0, 0], [1, 1, 1, 1, 0, 0]) and got[3] == ([2] * 6, [1] * 6)
    assert got[1] == got[2] == ([0] * 6, [0] * 6)
    empty = {r.input_ids[0] for r in V.encode_with_vocabulary(docs, v.limit(0), "text", 2).collect()}
    assert empty == {0, 1}
    plan = V.encode_with_vocabulary(docs, v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan  # one tokenisation for ids and mask


def test_a_large_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "LOOKUP_BYTES", 10)
    with pytest.raises(ValueError):
        V.encode_with_vocabulary(_docs(spark, ["x"]), spark.createDataFrame([("law", 5, 2)], "token string, n long, token_id long"))


# word and stem, as published with the algorithm and its extensions
PAIRS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil dying die skies sky enjoy enjoy say say by by""".split()


def test_published_stems():
    assert {w: porter.stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))


def test_stem_tokens(spark):
    df = spark.createDataFrame([(0, ["agreed", "ties", "the", "courts", "courts"]), (1, []), (2, None)], "id int, t array<string>")
    got = {r.id: r.s for r in df.select("id", porter.stem_tokens("t").alias("s")).collect()}
    assert got == {0: ["agre", "ties"[:3], "the", "court", "court"], 1: [], 2: []}


def test_types_are_read_off_counted_tokens(spark):
    """tokens are counted before their types are read off; the plain pieces are cut once."""
    from corpuskit.operators import abbreviations as A
    df = spark.createDataFrame([(1, "Dr. No met dr. Yes. No. (Dr. no)"), (2, None)], "doc_id long, text string")
    counts = A.period_counts(df)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    assert {r.type: (r.n_with, r.n_without) for r in counts.collect()} == {"dr": (3, 0), "no": (1, 2), "met": (0, 1), "yes": (1, 0)}
    s = {r.doc_id: (r.n, r.sentences) for r in A.split_learned(df, spark.createDataFrame([("dr",)], "type string"), plain="n").collect()}
    assert s[1] == (6, ["Dr. No met dr. Yes.", "No.", "(Dr. no)"]) and s[2][1] is None
