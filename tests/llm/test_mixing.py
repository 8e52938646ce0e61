import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import ceil

import duckdb
import pytest

from llm import mixing
from llm.mixing import mixed, oracle_sql, round_of, schedule


def plain_round(weights):
    """Earliest deadline first among released blocks, slot by slot."""
    names, every = sorted(weights), sum(weights.values())
    done, out = dict.fromkeys(names, 0), []
    for t in range(every):
        ready = [(ceil(Fraction((done[s] + 1) * every, weights[s])), s) for s in names if done[s] * every // weights[s] <= t]
        due, s = min(ready)
        assert due > t, "a deadline is missed"
        out.append((s, done[s]))
        done[s] += 1
    return {x: t for t, x in enumerate(out)}, every


def plain_schedule(rows, weights, block):
    sources = defaultdict(list)
    for doc_id, text, source in rows:
        sources[source or ""].append((hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest(), -1 if doc_id is None else doc_id, len(text or "")))
    weights = {s: max(1, weights.get(s, 1)) for s in sources}
    turns, every = plain_round(weights)
    out = []
    for s, docs in sources.items():
        at = 0
        for _, doc_id, n in sorted(docs):
            b = at // block
            out.append((None if doc_id < 0 else doc_id, s, n, at, b, b // weights[s] * every + turns[s, b % weights[s]]))
            at += n
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 5, "c": 1}, {"a": 1}, {}, {"a": 7, "b": 2, "": 4}])
def test_schedule_equals_simulation(spark, documents, weights):
    random.seed(len(weights))
    rows = [(i, random.choice([None, "", "x" * random.randrange(300)]), random.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(None, "null id", "a"), (7, "x" * 5000, "b")]
    got = [(r.doc_id, r.source, r.size, r.source_offset, r.block, r.slot) for r in schedule(documents(rows), weights, 500).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(plain_schedule(rows, weights, 500), key=key)


def test_every_prefix_is_within_a_block(spark, documents):
    rows = [(i, "x" * 10, f"s{i % 7}") for i in range(2100)]
    weights = {f"s{i}": w for i, w in enumerate([1, 2, 3, 5, 8, 13, 21])}
    got = schedule(documents(rows), weights, 10).collect()
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = {r.slot: r.source for r in got}
    every, count = sum(weights.values()), dict.fromkeys(weights, 0)
    for t in range(every * 10):
        count[slots[t]] += 1
        assert all(abs(Fraction((t + 1) * w, every) - count[s]) < 1 for s, w in weights.items())


def test_rounds_of_many_sources(spark, monkeypatch):
    """Every slot of a round is taken once and no block leaves its window, with far more sources than ``RESOLUTION``."""
    totals = spark.range(4000).selectExpr("concat('h', id) as source", "(id * 7919) % 100003 + 1 as total")
    rows = [(r.source, r.turn, r.slot, r.weight, r.every) for r in round_of(totals, None).collect()]
    every = rows[0][4]
    assert every > 10 * 4000 and sorted(r[2] for r in rows) == list(range(every)) and len({r[0] for r in rows}) == 4000
    assert all(turn * every // w <= slot < -(-(turn + 1) * every // w) for _, turn, slot, w, _ in rows)
    few = totals.where("total % 20 = 0")
    weights = {r.source: r.total % 50 + 1 for r in few.collect()}
    assert {(r.source, r.turn): r.slot for r in round_of(few, weights).collect()} == plain_round(weights)[0]
    monkeypatch.setattr(mixing, "MAX_SOURCES", 100)
    with pytest.raises(ValueError, match="at most 100"):
        round_of(totals, None)


def test_mixed_keeps_all_rows_and_columns(spark, documents):
    random.seed(9)
    rows = [(i, "x" * random.randrange(200), random.choice("aab")) for i in range(400)] + [(5, "again", "a"), (5, "again", "a"), (None, None, None)]
    df = documents(rows)
    out = mixed(df, {"a": 1, "b": 1}, 300)
    assert out.columns == df.columns
    got = out.collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(df.collect(), key=key)
    slot = {(r.doc_id, r.size): r.slot for r in schedule(df, {"a": 1, "b": 1}, 300).collect()}
    order = [slot[r.doc_id, len(r.text or "")] for r in got]
    assert order == sorted(order)
    assert schedule(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0


def test_equals_sql(spark):
    import __spark_entry__ as e
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    rel = con.sql(oracle_sql())
    df = e.queries()["op9_mixing"](spark, path).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
