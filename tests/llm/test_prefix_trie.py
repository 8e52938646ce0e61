import hashlib
import random
import re
import zlib

import pytest

from llm.prefix_trie import SpillingQueue, forward, scan, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, words int, key string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA)


def plain_paths(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(rows):
    paths = plain_paths(rows)
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        d = len(prefix)
        subtree = [q for q in nodes if q[:d] == prefix]
        children = [q for q in subtree if len(q) == d + 1]
        leaves = [q for q in subtree if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in subtree)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in subtree if q)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == d)
        out.append((min(members), d, min(nodes[prefix[:-1]]) if d else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n, texts=("a b", "c", "", "d  e\tf", None)):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in rng.sample(range(-30, 3 * n), n) for t in range(rng.randint(1, 6))]


@pytest.mark.parametrize("held,piece", [(200_000, 1 << 16), (2, 3)])
def test_equals_brute_force(spark, held, piece):
    rows = conversations(held, 150)
    rows += [(2000 + c, t, "user", "hot first turn" if t == 0 else f"own {c % 7}") for c in range(80) for t in range(2)]  # a hot turn, groups of copies
    rows += [(None, 0, "user", "no id"), (5000, None, "user", "x y"), (5000, None, "user", "x y"), (5000, 3, "user", "z")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answers(trie(table(spark, rows).repartition(3), held=held, piece=piece)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_turnless_and_shallow(spark):
    deep = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2]  # their first turns are those of conversation 0, which is absent
    rows = [(c, 0, "user", "gone") for c in deep]
    got = answers(trie(table(spark, rows)))
    assert got == plain(rows) == [(deep[0], 0, None, len(deep), 0, 1, 0, hashlib.sha256(",".join(map(str, deep)).encode()).hexdigest())]
    rows += [(c, t, "user", f"turn {t}") for c in deep[:2] for t in (1, 2)]
    assert answers(trie(table(spark, rows))) == plain(rows)


def test_empty_table(spark):
    df = trie(table(spark, [(1, 1, "user", "x")]).limit(0))
    assert df.count() == 0 and df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_very_long_conversation_and_text(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (40, 47) for t in range(1500)] + [(41, 0, "user", "word " * 200_000)]
    got = answers(trie(table(spark, rows)))
    paths = plain_paths(rows)
    assert len(got) == 1 + len({tuple(p[:d]) for p in paths.values() for d in range(1, len(p) + 1)})
    assert sum(1 for g in got if g[3] >= 2) >= 1500
    root = next(g for g in got if g[1] == 0)
    assert root[:4] == (40, 0, None, 3)


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_queue_gives_all_messages_in_order(held):
    rng = random.Random(held)
    queue, plain_messages = SpillingQueue(held), {}
    keys = [(s, -d, bytes([k])) for s in range(2) for d in (2, 1, 0) for k in range(5)]
    for i, key in enumerate(keys):
        for later in rng.choices(keys[i:], k=6):
            queue.push(later, len(plain_messages.setdefault(later, [])))
            plain_messages[later].append(len(plain_messages[later]))
        assert sorted(queue.pop_all(key)) == sorted(plain_messages.get(key, []))
    assert queue.spilled > 0 or held == 1000


def test_shards_leave_few_roots():
    """However many conversations a node has, a shard's roots are on two paths."""
    rows = [([b"same", bytes([i])], [1, 1], i) for i in range(200)]
    nodes = [r for r in scan(iter(rows), 0) if r[14] == 0]
    assert len(nodes) == 202 and sum(1 for r in nodes if r[3]) == 4  # root, "same", the first and the last leaf
    in_order = sorted((r[:14] for r in nodes), key=lambda r: (-r[6], r[1]))
    out = list(forward(iter(in_order), SpillingQueue(10)))
    assert sum(1 for root, _ in out if root) == 4 and sum(1 for root, _ in out if not root) == 198
    same = next(r for root, r in out if root and r[2] == 1)
    assert same[4] == 200 and same[6] == 198 and same[7] == 198
