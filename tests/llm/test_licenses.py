import random
import re

import duckdb
import pytest

from llm.licenses import GAP, PHRASES, TEMPLATES, license_scan, oracle_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_base(t):
    w = words_of(t)
    found = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_and_templates(spark, documents):
    random.seed(1)
    noise = lambda n: " ".join(f"w{random.randrange(999)}" for _ in range(n))
    whole = [f"{noise(30)}\n{text}.\n{noise(20)}" for _, _, text in TEMPLATES]
    long = [(label, text.split()) for label, _, text in TEMPLATES if len(text.split()) > 15]
    mended = []  # a word put in and one left out: neighbouring diagonals
    for label, w in long:
        w = w[:5] + ["inserted", "words"] + w[5:9] + w[10:]
        mended.append((label, f"{noise(8)} {' '.join(w)} {noise(8)}"))
    odd = [None, "", "MIT  LICENSE", "the mit-license and the Apache License; mit license", "permission is hereby", "general public  licence", "é mit license é", "Kit mit license"]
    texts = whole + [t for _, t in mended] + odd + [noise(200) for _ in range(20)]
    got = {r.doc_id: r for r in license_scan(documents(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert got[i].labels == label and got[i].score == 1  # its own label and no sibling's
    for i, (label, _) in enumerate(mended):
        assert label in got[len(whole) + i].labels.split(",") and got[len(whole) + i].score > 0.7
    for i in range(len(texts) - 20, len(texts)):
        assert got[i].labels == "" and got[i].score == 0
    assert GAP >= 2


OWN = [
    ("She was released under the table and ran away", ""), ("The album was released under the name Blue", ""),
    ("Our code is available under the terms of the Acme license", ""), ("This project is licensed under the terms of the BSD license", "bsd"),
    ("Released under the GNU General Public License", "gpl"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY 4.0.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Released under the MIT License. Licensed under CC BY-SA 4.0", "cc-by-sa,mit"),
]


@pytest.mark.parametrize("around", ["{}", "before it stands some text {} and some after", "{} {}"])
def test_each_wording_has_its_own_label(spark, documents, around):
    got = {r.doc_id: r.labels for r in license_scan(documents([around.replace("{}", t) for t, _ in OWN])).collect()}
    assert got == {i: label for i, (_, label) in enumerate(OWN)}


def test_very_long_text(spark, documents):
    long = "word " * 300_000 + "Licensed under CC BY-NC 4.0 " + "word " * 300_000 + "under the MIT License"
    r = license_scan(documents([long])).first()
    assert (r.n_words, r.labels, r.n_base, r.first_word) == (600_011, "cc-by-nc,mit", 1, 600_009)


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    text = "Released under the MIT License."
    df = documents([(1, text, "s"), (1, text, "s"), (None, text, None), (1, "other", "s")])
    rows = sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in license_scan(df).collect())
    assert rows == [(0, 5, "mit", 1.0), (1, 1, "", 0.0), (1, 5, "mit", 1.0), (1, 5, "mit", 1.0)]
    assert license_scan(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_sql(spark, sf):
    import __spark_entry__ as e
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    rel = con.sql(oracle_sql())
    df = e.queries()["op10_license_scan"](spark, path).select(*rel.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_own_labels_equal_sql(spark, documents):
    texts = [f"{a} and so on {b}" for a, _ in OWN for b, _ in OWN] + [t for _, _, t in TEMPLATES] + [None, ""]
    df = documents(texts)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    rel = con.sql(oracle_sql())
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, license_scan(df).select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)
