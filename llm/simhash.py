"""SimHash near-duplicates: all pairs of fingerprints at a few differing bits, as components.

Method: Gray-order hierarchical index. Fingerprints are sorted by their rank in the
reflected Gray code, so that neighbours differ in few bits. Runs of ``FANOUT`` neighbours
form a node, runs of nodes a node above; a node keeps the bits that all below it share
(mask and pattern), and each level only what the level above has not factored out
already. A search walks from the top and adds up the differences found on the way: a
node whose sum exceeds the limit goes with all that is below it, and at the leaves
the sum is the full distance. Nodes whose fingerprints are all in the query's
component already go as well, so a dense cluster costs no square of its size.

A fingerprint: one bit for each bit position of the XXH64 hashes (seed 42) of all
word shingles of the text, set where more than half of the hashes have it. Rows with one
fingerprint are one entry of the index, so copies are counted out before anything is dealt.

One index over a corpus would be one task. Fingerprints that differ in at most ``d`` bits
agree in one of any ``d + 1`` blocks of bits, so each is dealt to ``d + 1`` groups, and links
are searched inside the groups, exactly. A group of more than ``GROUP`` fingerprints is dealt
again, by blocks of the bits that its members may still differ in; after at most
``LEVELS`` such steps so few bits are free that no group can be larger. Nothing is capped.
A task indexes many groups at once, each under roots of its own, and returns links to the
least fingerprint reached in a group (at most one a row), of which Spark makes components.

Defined cases: null, empty and word-less texts have fingerprint zero and link like any
other; fewer than ``k`` words are one shingle; long texts are hashed in slices, no text is
cut; repeated rows, and rows with one id, are rows of their own; a null id is never the
smallest unless all ids of the component are null; other columns are not read; an empty
table gives an empty result. No order among equals matters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, ids_and_text, saved, ship

SEED = 42
BITS = 64
FANOUT = 8
GROUP = 4096  # fingerprints of one group in one task; 2 ** 12, see masks()
LEVELS = 6
SLICE = 1 << 16  # words hashed at once
BATCH = 1 << 15  # rows of groups indexed at once
QUERIES = 1024  # fingerprints searched at once
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, lowest bit first."""
    out = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        out += np.unpackbits(hashes[at:at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, k: int = 3) -> int:
    """Fingerprint of a text: A-Z lower-cased, words between space and 0x09-0x0D, all ``k``-word
    shingles, repeats included, joined by one space."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    count, total = np.zeros(BITS, dtype=np.int64), len(words) - k + 1
    for at in range(0, total, SLICE):
        part = words[at:at + SLICE + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        count += _bit_counts(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], dtype="<u8"))
    return sum(1 << i for i in np.flatnonzero(2 * count > total).tolist())


def _fingerprints(k: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                value = np.array([fingerprint(t.as_py(), k) for t in part.column(1)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value.view(np.int64))], ["doc_id", "fp"])
    return run


def masks(blocks: int) -> list[list[tuple[int, int]]]:
    """By level, (number of the mask above, mask): the bits in which a group's members agree. Each
    mask extends the one above by one of ``blocks`` near-equal parts of the bits that are still free."""
    out, above = [], [0]
    for _ in range(LEVELS):
        level = []
        for up, mask in enumerate(above):
            free = [i for i in range(BITS) if not mask >> i & 1]
            if len(free) <= GROUP.bit_length() - 1:  # no more than GROUP members: such a group is never dealt again
                continue
            for j in range(blocks):
                level.append((up, mask | sum(1 << i for i in free[j * len(free) // blocks:(j + 1) * len(free) // blocks])))
        if not level:
            break
        out.append(level)
        above = [m for _, m in level]
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over the fingerprints of several groups. ``group`` numbers are sorted;
    ``fp`` is in Gray order inside each group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.group, self.fp = group, fp
        # from the leaves up; a level: first and end position, mask, pattern, group, first child and end child
        n = len(fp)
        at = np.arange(n + 1)
        levels = [{"first": at[:-1], "end": at[1:], "mask": np.full(n, ~np.uint64(0)), "pattern": fp, "group": group}]
        while True:
            below = levels[-1]
            change = np.concatenate([[True], below["group"][1:] != below["group"][:-1]])
            begins = np.flatnonzero(change)
            if len(begins) == len(below["group"]):  # one node a group: these are the roots
                break
            inside = np.arange(len(change)) - begins[np.cumsum(change) - 1]
            start = np.flatnonzero(inside % FANOUT == 0)
            stop = np.append(start[1:], len(change))
            both = np.bitwise_and.reduceat(below["mask"], start)
            differ = np.bitwise_or.reduceat(below["pattern"], start) ^ np.bitwise_and.reduceat(below["pattern"], start)
            mask = both & ~differ
            levels.append({"first": below["first"][start], "end": below["end"][stop - 1], "mask": mask, "pattern": below["pattern"][start] & mask,
                           "group": below["group"][start], "child": start, "stop": stop})
        # what a level adds to the one above
        for up, low in zip(levels[1:], levels):
            low["own"] = low["mask"] & ~np.repeat(up["mask"], up["stop"] - up["child"])
        levels[-1]["own"] = levels[-1]["mask"]
        self.levels = levels[::-1]
        self.root = np.searchsorted(self.levels[0]["group"], group)

    def links(self, queries: np.ndarray, d: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position of a query, later position) at most ``d`` bits apart, but not those whose
        labels agree already."""
        same = []
        for level in self.levels:
            low = np.minimum.reduceat(label, level["first"])
            same.append(np.where(low == np.maximum.reduceat(label, level["first"]), low, -1))
        q, node = queries, self.root[queries]
        so_far = np.zeros(len(q), dtype=np.uint8)
        for depth, level in enumerate(self.levels):
            so_far = so_far + np.bitwise_count((self.fp[q] ^ level["pattern"][node]) & level["own"][node])
            on = (so_far <= d) & (level["end"][node] > q + 1) & (same[depth][node] != label[q])
            q, node, so_far = q[on], node[on], so_far[on]
            if "child" not in level:
                break
            n = level["stop"][node] - level["child"][node]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, so_far, node = np.repeat(q, n), np.repeat(so_far, n), np.repeat(level["child"][node], n) + step
        return q, node


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the components of ``a[i]`` and ``b[i]``; a label is the least position of its component."""
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def component_labels(group: np.ndarray, fp: np.ndarray, d: int) -> np.ndarray:
    """For each position the least position that links of at most ``d`` bits reach inside the group."""
    index = GrayIndex(group, fp)
    label = np.arange(len(fp))
    for at in range(0, len(fp), QUERIES):
        a, b = index.links(np.arange(at, min(len(fp), at + QUERIES)), d, label)
        if len(a):
            _merge(label, a, b)
    return label


def _linked(d: int):
    """Rows (t, part, fp) sorted by group -> (fp, least fp that links reach in the group)."""

    def links(t, part, fp):
        group = np.cumsum(np.concatenate([[False], (t[1:] != t[:-1]) | (part[1:] != part[:-1])]))
        fp = fp.view(np.uint64)
        order = np.lexsort((gray_rank(fp), group))
        group, fp = group[order], fp[order]
        label = component_labels(group, fp, d)
        on = label != np.arange(len(fp))
        return pa.record_batch([pa.array(fp[on].view(np.int64)), pa.array(fp[label[on]].view(np.int64))], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size < BATCH:
                continue
            t, part, fp = (np.concatenate(c) for c in zip(*held))
            new = np.flatnonzero((t[1:] != t[:-1]) | (part[1:] != part[:-1]))
            if not len(new):
                continue  # one group so far, of at most GROUP rows
            cut = int(new[-1]) + 1  # the last group may go on
            yield links(t[:cut], part[:cut], fp[:cut])
            held, size = [[t[cut:], part[cut:], fp[cut:]]], len(t) - cut
        if size:
            yield links(*(np.concatenate(c) for c in zip(*held)))
    return run


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row."""
    ship(docs.sparkSession)
    return ids_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(k), "doc_id long, fp long")


def links(fps: DataFrame, d: int = 3) -> DataFrame:
    """Pairs (a, b) that span the components of distinct fingerprints ``fps`` (column fp, long) which
    differ in at most ``d`` bits."""
    spark = fps.sparkSession
    ship(spark)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    found = []
    above = None
    for depth, level in enumerate(masks(d + 1)):
        if depth == 0:
            rules = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, (_, m) in enumerate(level)])
            ruled = fps.select("fp", F.inline(rules))
        else:
            rule = spark.createDataFrame([(t, up, signed(m)) for t, (up, m) in enumerate(level)], "t int, up int, mask long")  # at most 4 ** LEVELS rows
            ruled = above.join(F.broadcast(rule), "up")
        dealt = saved(ruled.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"), f"dealt-{depth}")
        large = saved(dealt.groupBy("t", "part").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("t", "part"), "large")
        some = large.limit(1).count() > 0
        rest = dealt.join(large, ["t", "part"], "left_anti") if some else dealt
        rest = rest.repartition("t", "part").sortWithinPartitions("t", "part")
        found.append(rest.mapInArrow(_linked(d), "a long, b long"))
        if not some:
            break
        above = dealt.join(large, ["t", "part"], "left_semi").select(F.col("t").alias("up"), "fp")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, k: int = 3, d: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id that links of
    at most ``d`` differing bits reach) of each row; see the module text."""
    rows = saved(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comp = components(links(classes.select("fp"), d)).select(F.col("node").alias("fp"), "root")
    named = classes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    label = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(label, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
