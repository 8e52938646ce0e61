import random

import public_tokenizers

from llm.bpe import byte_vocabulary
from llm.wordpiece import Automaton, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def greedy(first, rest, word, longest=128):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, rest
    return n


def test_automaton_equals_greedy_longest_match():
    random.seed(5)
    piece = lambda: bytes(random.choice(b"abc") for _ in range(random.randint(1, 5)))
    for _ in range(300):
        first, rest = ({piece() for _ in range(random.randint(1, 12))} for _ in range(2))
        a = Automaton(first, rest)
        for _ in range(40):
            w = bytes(random.choice(b"abc") for _ in range(random.randint(0, 14)))
            assert a.count(w) == greedy(first, rest, w), (first, rest, w)


def test_byte_vocabulary_is_that_of_the_rank_file():
    import base64
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert byte_vocabulary(PATH) == ranks


def test_token_counts(spark, documents):
    pieces = byte_vocabulary(PATH)
    first, rest = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    texts = [None, "", " \n\t", "word", "Hello, world!\nthe  thing\x0bé", "x" * 5000, "same same", "same same", "\x85 \xa0 a\x1cb"] + [" ".join(random.choices(["alpha", "straße", "queue", "12.5"], k=50))]
    got = {r.doc_id: r for r in token_counts(documents(texts), PATH).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(greedy(first, rest, b" " + w) for w in words), 0)
    assert token_counts(documents(texts).limit(0), PATH).count() == 0
    assert token_counts(documents([(None, "a", None), (1, "a", "s"), (1, "a", "s")]), PATH).count() == 3


def test_sf_table(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    pieces = byte_vocabulary(PATH)
    first, rest = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    known = {}
    for r in e.queries()["op5_token_counts"](spark, sf).collect():
        words = texts[r.doc_id].encode().split()
        for w in set(words) - set(known):
            known[w] = greedy(first, rest, b" " + w)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))
