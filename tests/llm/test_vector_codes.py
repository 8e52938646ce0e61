import hashlib

import numpy as np
import pytest

from llm import vector_codes
from llm.vector_codes import compress, equal_average_search

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "c", 1) for i, v, lab in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    """Full search with Python integers."""
    rows = sorted(((i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = [[tuple(r[1][p * w:(p + 1) * w]) for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = [nearest(c[p], books[p])[1] for c in cut]
            books[p] = [tuple(sum(col) // len(col) for col in zip(*mine)) if (mine := [c[p] for c, t in zip(cut, to) if t == e]) else books[p][e] for e in range(len(books[p]))]
    out, label = [], {}
    for r, c in zip(rows, cut):
        got = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in got), sum(d for d, _ in got)))
        label[r[2]] = label.get(r[2], 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, label[lab], digest) for i, lab, c, e in out), key=str)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("spread", [1, 3, 4000])
def test_equal_average_search_equals_full_search(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 16, 40):
        entries = rng.integers(-spread, spread + 1, size=(k, 6))  # few values: many ties of sums and distances
        x = rng.integers(-spread, spread + 1, size=(500, 6))
        index, d = equal_average_search(x, entries)
        full = ((x[:, None] - entries) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_search_ends_early():
    rng = np.random.default_rng(1)
    looked = []
    x, entries = (rng.integers(-400, 401, size=(n, 1)) + rng.integers(-40, 41, size=(n, 8)) for n in (2000, 64))
    equal_average_search(x, entries, looked)
    assert 2000 <= sum(looked) < 0.3 * 2000 * 64


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_full_search_with_python_integers(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 16)) if seed else rng.integers(-2, 3, size=(200, 16)) / 4096  # the second: ties
    rows = [(i * 3 - 50, x[i], [None, 0, 1, 2][i % 4]) for i in range(200)]
    rows += rows[:5] + [(None, x[7], 1)]
    assert answers(compress(table(spark, rows).repartition(5))) == plain(rows)


def test_few_rows_and_odd_rows(spark):
    good = [(5, np.arange(8) / 7, 1), (3, -np.arange(8) / 5, None), (4, np.zeros(8), 1)]
    odd = [(1, None, 1), (2, [], 1), (6, [1, None] * 4, 1), (7, [float("nan")] * 8, 1), (8, [float("-inf")] + [0] * 7, 1), (9, [1, 2, 3], 1), (0, [1] * 16, 2)]
    assert answers(compress(table(spark, good + odd))) == plain(good)
    assert compress(table(spark, odd[:4])).count() == 0 and compress(table(spark, good).limit(0)).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        compress(table(spark, [(1, [1e9] * 8, 0)]))
    with pytest.raises(ValueError):
        compress(table(spark, good), entries=257)


def test_slices_and_one_hot_label(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8), 1 if i < 60 else i) for i in range(90)]
    assert answers(compress(table(spark, rows))) == plain(rows)
