"""Rows-only queries checked against brute force on the small fixture."""

import re

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _pairs():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    return con.sql("SELECT u.conv_id, u.turn, u.text, a.text FROM conversations u JOIN conversations a "
                   "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
                   "WHERE u.role = 'user' AND a.role = 'assistant'").fetchall()


def _tok(s):
    s = re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()
    return s.split(" ") if s else []


def _lcs(a, b):
    dp = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            cur = dp[j]
            dp[j] = prev + 1 if x == y else max(dp[j], dp[j - 1])
            prev = cur
    return dp[-1]


def test_rouge_l_against_dynamic_programming(spark):
    got = {(r.conv_id, r.turn): r.fmeasure for r in E.queries()["rougeL"](spark, SF).collect()}
    want = {}
    for cid, turn, pred, ref in _pairs():
        p, r = _tok(pred), _tok(ref)
        lcs = _lcs(p, r)
        prec = lcs / len(p) if p else 0.0
        rec = lcs / len(r) if r else 0.0
        want[(cid, turn)] = round(2 * prec * rec / (prec + rec), 6) if prec + rec else 0.0
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_corpus_rouge_l_against_dynamic_programming(spark):
    f = []
    for _, _, pred, ref in _pairs():
        p, r = _tok(pred), _tok(ref)
        lcs = _lcs(p, r)
        f.append(2 * lcs / (len(p) + len(r)) if lcs else 0.0)
    row = E.queries()["evaluate_generation_lcs"](spark, SF).first()
    assert row.n_pairs == len(f) and row.rougeL == pytest.approx(100 * sum(f) / len(f), abs=1e-4) and row.rougeL > 0
    plain = E.queries()["evaluate_generation"](spark, SF).first().asDict()
    assert {k: row[k] for k in plain} == plain


def test_score_with_model_against_pandas(spark):
    import pandas as pd
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {}
    for i, t in zip(docs.doc_id, docs.text):
        ws = t.split()
        want[int(i)] = sum(1 for w in ws if w[:1].isupper()) / len(ws) if ws else 0.0
    got = {r.doc_id: (r.capital_share, r.backend, r.error) for r in E.queries()["score_with_model"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(v[1] == "fallback_1" and v[2] is None and v[0] == pytest.approx(want[k]) for k, v in got.items())
