import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import wordhash
from tests_llm_plain import WORD, plain_set

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbÄé \n\t\x0b\x85\xa0", max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_lines_and_shingles_equal_plain_python(texts):
    words, n = wordhash.batch_hashes(texts)
    plain = [WORD.findall(t or "") for t in texts]
    assert n.tolist() == [len(w) for w in plain]
    flat = [w for ws in plain for w in ws]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    lines, m = wordhash.batch_hashes(texts, lines=True)
    flat = [x for t in texts for x in (t or "").split("\n") if WORD.search(x)]
    assert m.sum() == len(flat) and len(set(zip(flat, lines.tolist()))) == len(set(flat)) == len(set(lines.tolist()))
    sets = wordhash.shingle_sets(texts)
    for (a, s) in zip(texts, sets):
        assert len(s) == len(plain_set(a)) and (np.diff(s.astype(object)) > 0).all()
        for (b, t) in zip(texts, sets):
            assert len(np.intersect1d(s, t)) == len(plain_set(a) & plain_set(b))


@pytest.mark.parametrize("lines", [False, True])
def test_long_texts_in_slices(monkeypatch, lines):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab c\n"), size=n)) for n in (5000, 10, 900, 0, 3000)] + ["x" * 4000 + " y", None]
    whole, n = wordhash.batch_hashes(texts, lines=lines)
    monkeypatch.setattr(wordhash, "SLICE", 64)
    parts, m = wordhash.batch_hashes(texts, lines=lines)
    assert (whole == parts).all() and (n == m).all()
