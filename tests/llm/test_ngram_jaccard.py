import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import llm.ngram_jaccard as nj
from llm.common import components
from llm.rtree import CountRTree, spanning_links
from tests_llm_plain import plain_set


def plain_components(rows, k=5):
    """(id, text) -> {row number: (set size, smallest id reachable)}, by all pairs that share a shingle."""
    sets = [plain_set(t, k) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def made_up(seed, n=160):
    """Texts with exact copies, chains of near copies, a passage that many share and one hot group."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.25:
            out.append(rng.choice(out))
        elif out and kind < 0.7:
            w = rng.choice(out[:20]).split()
            for _ in range(rng.randrange(1, 6)):
                if w:
                    w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        elif kind < 0.85:
            out.append(" ".join([word() for _ in range(rng.randrange(1, 40))] + passage))
        else:
            out.append(" ".join(word() for _ in range(rng.randrange(0, 120))))
    return out


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, size=(700, 16)).astype(np.int32)
    points[350:] = points[:350]
    points[350:, 0] += 1
    sizes = points.sum(axis=1).astype(np.int64)
    tree = CountRTree(points, sizes)
    for i in range(0, 700, 13):
        found = set(tree.order[tree.search(points[i], sizes[i], 80, 100)].tolist())
        bound = np.minimum(points, points[i]).sum(axis=1)
        plain = (180 * bound >= 80 * (sizes + sizes[i])) & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i]))
        assert found == set(np.flatnonzero(plain).tolist())


@pytest.mark.parametrize("sides", [False, True])
def test_spanning_links_span_the_components(sides):
    rng = np.random.default_rng(1)
    base = rng.poisson(4, size=(12, 16))
    points = np.stack([base[rng.integers(12)] + (rng.random(16) < 0.1) for _ in range(150)]).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    side = rng.integers(0, 2, size=150) if sides else None
    ok = lambda i, j: 190 * int(np.minimum(points[i], points[j]).sum()) >= 90 * int(sizes[i] + sizes[j])

    def comps(links):
        label = list(range(150))
        for a, b in links:
            a, b = label[a], label[b]
            label = [a if x == b else x for x in label]
        return {frozenset(i for i in range(150) if label[i] == x) for x in set(label)}
    every = [(i, j) for i in range(150) for j in range(i) if ok(i, j) and (not sides or side[i] != side[j])]
    assert comps(spanning_links(points, sizes, 90, 100, side=side)) == comps(every)
    odd = [(i, j) for i, j in every if (i + j) % 3]
    assert comps(spanning_links(points, sizes, 90, 100, verify=lambda i, j: (max(i, j), min(i, j)) in set(odd), side=side)) == comps(odd)


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3)])
def test_components_equal_brute_force(spark, documents, monkeypatch, seed, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "CLUSTER_ROWS", block)
    monkeypatch.setattr(nj, "CHUNK", 500)
    texts = [None, "", " \n", "a b", "A B", "a b c d e", "x " * 3000] + made_up(seed)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = nj.near_duplicates(documents([(i, t, "s") for i, t in rows]).repartition(4)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_repeated_rows_null_ids_and_empty_table(spark, documents):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "A b c d e f"), (2, None), (None, ""), (3, "z y x")]
    df = documents([(i, t, "s") for i, t in rows])
    got = nj.near_duplicates(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(plain_components(rows), key=key)
    assert nj.near_duplicates(df.limit(0)).count() == 0
    assert nj.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [5, None])
def test_a_hot_id_reaches_no_block_twice(spark, documents, monkeypatch, hot):
    """A third of all rows repeat one id (or have none) and one text that has near copies: one row a set is read again."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(hot, base)] * 120 + [(1000 + i, base + f" end{i}") for i in range(6)] + list(enumerate(made_up(4, 200)))
    counts = []
    read = nj._read_again

    def counted(texts, member, k):
        out = read(texts, member, k)
        counts.append((out.count(), out.select("key").distinct().count(), member.count()))
        return out
    monkeypatch.setattr(nj, "_read_again", counted)
    monkeypatch.setattr(nj, "SEEN", 3)
    got = nj.near_duplicates(documents([(i, t, "s") for i, t in rows]).repartition(6)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(plain_components(rows), key=key)
    (n, sets, members), = counts
    assert n == sets <= members + 20


@pytest.mark.parametrize("inline", [100, 0])
def test_one_of_each(spark, documents, inline):
    texts = made_up(3, 80)
    df = documents(texts)
    kept = nj.one_of_each(df, inline=inline)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in plain_components(list(enumerate(texts))) if i == c}


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(100, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_sf_table(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, e.queries()["op3_ngram_jaccard"](spark, sf).collect())) == sorted(plain_components(rows))
