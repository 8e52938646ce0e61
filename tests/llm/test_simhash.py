import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import llm.simhash as simhash
from llm.simhash import GrayIndex, component_labels, fingerprint, gray_rank, links, masks, near_duplicates

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Least position reachable, by all pairs."""
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            return label
        label = new
    return label


def near(rng, base, bits):
    for b in rng.choice(64, size=bits, replace=False):
        base ^= 1 << int(b)
    return base


def test_fingerprints_equal_the_plain_ones(spark, documents):
    rng = np.random.default_rng(0)
    vocabulary = ["Alpha", "beta", "ÄRGER", "ß", "x y", "\U0001f600", "1,2", "\x1cq"]
    texts = [None, "", " \n\t", "One", "one TWO", "a b c", "A  b\tc\nd", "É É É É"]
    texts += [" ".join(rng.choice(vocabulary, size=n)) for n in (3, 4, 5, 60, 700)]
    got = {r.doc_id: r.fingerprint for r in near_duplicates(documents(texts)).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert spark.sql("select lower(hex(xxhash64('a b c')))").first()[0] == got[5]


def test_long_text_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice(["aa", "b", "ccc", "dd"], size=1000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 37)
    assert fingerprint(text) == whole == plain_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_masks_cover_and_end():
    levels = masks(4)
    assert [len(x) for x in levels[:2]] == [4, 16] and len(levels) <= simhash.LEVELS
    assert (levels[0][0][1] | levels[0][1][1] | levels[0][2][1] | levels[0][3][1]) == MASK
    last = levels[-1]
    assert all(64 - m.bit_count() <= 12 for _, m in last)  # so a group there holds at most GROUP
    for above, level in zip([[(0, 0)], *levels], levels):
        for up, m in level:
            assert above[up][1] & m == above[up][1] != m


@pytest.mark.parametrize("queries", [1024, 5])
def test_index_finds_all_links_of_each_group(monkeypatch, queries):
    monkeypatch.setattr(simhash, "QUERIES", queries)
    rng = np.random.default_rng(2)
    group, fps = [], []
    for g, n in enumerate([1, 2, 7, 8, 9, 64, 65, 300]):
        centres = [int(x) for x in rng.integers(0, 1 << 63, size=4)]
        own = sorted({near(rng, centres[int(rng.integers(4))], int(rng.integers(0, 7))) for _ in range(n)})
        group += [g] * len(own)
        fps += own
    group, fp = np.array(group), np.array(fps, dtype=np.uint64)
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    index = GrayIndex(group, fp)
    a, b = index.links(np.arange(len(fp)), 3, np.arange(len(fp)))
    plain = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == plain and len(a) == len(plain)
    label = component_labels(group, fp, 3)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        assert (label[at] - at[0]).tolist() == plain_components([int(x) for x in fp[at]])


def test_upper_nodes_prune():
    """Most of the leaves are never looked at."""
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 63, size=4000).astype(np.uint64))
    fp = fp[np.argsort(gray_rank(fp))]
    index = GrayIndex(np.zeros(len(fp), dtype=np.int64), fp)
    seen = []
    own = index.levels[-1]["own"]

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(at))
            return np.asarray(super().__getitem__(at))
    index.levels[-1]["own"] = own.view(Counted)
    index.links(np.arange(len(fp)), 3, np.arange(len(fp)))
    assert sum(seen) < 0.6 * len(fp) ** 2 / 2


@pytest.mark.parametrize("group", [4096, 16])
def test_links_through_large_groups(spark, monkeypatch, group):
    """Groups beyond the bound are dealt again, down to few free bits; the components stay."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "BATCH", 50)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 63))
    fps = {near(rng, centre, int(rng.integers(0, 5))) for _ in range(150)} | {near(rng, centre ^ MASK, int(rng.integers(0, 9))) for _ in range(60)} | {0, 1, 7, 15, MASK}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.a & MASK, r.b & MASK) for r in links(df).collect()]
    at = {f: i for i, f in enumerate(fps)}
    label = np.arange(len(fps))
    if edges:
        simhash._merge(label, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert label.tolist() == plain_components(fps)


def test_table_against_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, size=200)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(len(t)))] = "changed"
        rows.append((i * 7 - 100, " ".join(t), "s0"))
    rows += [(5000, None, "s0"), (4000, "", "s0"), (4001, " \n", "s0"), (None, rows[0][1], "s0"), (None, "alone in the world today", "s0"), rows[3], rows[3]]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(documents(rows).repartition(4)).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    label = plain_components(fps)
    least = {}
    for (i, _, _), root in zip(rows, label):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    assert got == sorted(((i, f"{f:016x}", least.get(root)) for (i, _, _), f, root in zip(rows, fps, label)), key=str)
    assert 1 < len(set(label)) < 60  # most rows link


def test_empty_table_and_one_text_in_a_third_of_the_rows(spark, documents):
    empty = near_duplicates(documents([("1", "x", "s")][:0] or ["x"]).limit(0))
    assert empty.count() == 0 and "fingerprint" in empty.columns
    rows = ["same old text again and again"] * 500 + [f"text number {i} {i * 7} {i * 13} of its own kind" for i in range(40)]
    got = near_duplicates(documents(rows)).where(F.col("doc_id") < 500).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
