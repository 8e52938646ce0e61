"""Near-duplicate documents: an exact join on the Jaccard similarity of word shingles.

Method: count-vector R-tree. Every document is the set of its distinct k-word
shingles; a set's shingles are hashed into ``GROUPS`` groups and the group counts are
a point. The sum of coordinate minima bounds the overlap of two sets, an R-tree over
the points finds pairs whose bound allows the similarity, and the sets themselves
confirm the pairs that survive.

One tree over a corpus would be one task, so exact keys deal the points to trees:

1. ``_heavy``: shingles that recur inside a task's chunk are counted into a table of
   ``CELLS`` cells (a fixed size); it orders all shingles, seldom ones first. Any
   order gives the same result, this one keeps common passages out of the keys.
2. ``_keys``: two sets of similarity p/q must share one of their first
   ``n - ceil(p*n/q) + 1`` shingles in that order. A key that only one set has is
   dropped by a grouped count; keys with the same holders count once.
3. ``_bound_blocks``: an R-tree on the points of each key's holders, and the same bound at
   the sets' own finer resolution (about four shingles a group), gives links that span
   the components of "the bound allows it". Keys with more than ``BLOCK``
   holders are cut into sub-blocks, all pairs of which are looked at as separate
   blocks: nothing is capped and no task holds more than two sub-blocks.
4. Components of these links are small candidate clusters that hold every true link.
   Their sets are read once more from the texts and joined to the clusters; in each
   cluster (cut the same way) an R-tree proposes and the sets confirm.

Exact copies of a set count as one point all along, and the search never looks at a
pair inside one component, so a group of copies costs no square of its size.

Defined cases: null or word-less text has no shingles, links with nothing and is its
own component; fewer than k words are one shingle; repeated rows are rows of their
own, in one component when their text has a shingle; a null id is never the smallest
unless all ids of the component are null; other columns are not read; an empty table
gives an empty result. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import components, ids_and_text, saved, ship
from llm.rtree import spanning_links
from llm.wordhash import mix, shingle_sets

GROUPS = 64
CELL_BITS = 22  # cells of the order table: 4 MB, whatever the corpus
CHUNK = 2_000_000  # shingles that a task counts at once
BLOCK = 4096  # holders of a key in one sub-block
CLUSTER_ROWS, CLUSTER_SHINGLES = 2048, 2_000_000  # sets and shingles in one sub-block of a cluster
BITMAP_BITS = 24
SEEN = 200_000  # digests that a task remembers when sets are read again


def _batches(batches, size: int = 256):
    """Rows of Arrow batches in parts of at most ``size`` rows, as Python lists by column."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            part = b.slice(at, size)
            yield [c.to_pylist() for c in part.columns]


def _heavy(k: int):
    def run(batches):
        held, size = [], 0

        def count():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n >= 2] >> np.uint64(64 - CELL_BITS), n[n >= 2]
            cell, at = np.unique(u, return_inverse=True)
            return pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64))], ["cell", "n"])

        for (texts,) in _batches(batches):
            sets = shingle_sets(texts, k)
            held += sets
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield count()
                held, size = [], 0
        if size:
            yield count()
    return run


def _order_table(texts: DataFrame, k: int):
    """Weight of each cell, as one byte: four times the binary logarithm of its count."""
    rows = (texts.mapInArrow(_heavy(k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
            .where("n >= 3").select("cell", F.floor(4 * F.log2("n")).cast("int").alias("w")).toPandas())
    weight = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    weight[rows["cell"].to_numpy(dtype=np.int64)] = rows["w"].to_numpy(dtype=np.int64)
    return texts.sparkSession.sparkContext.broadcast(weight)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


KEYS = "kind int, doc_id long, n long, key binary, short long, token long, point binary"


def _counts(s: np.ndarray) -> bytes:
    """Group counts of a set at its own resolution, about four elements a group: a byte each
    (after a mark of the width), or four bytes where a group holds more than 255."""
    groups = max(GROUPS, 1 << max(0, (len(s) - 1).bit_length() - 2))
    c = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return b"\x01" + c.astype("u1").tobytes() if c.max() < 256 else b"\x04" + c.astype("<u4").tobytes()


def _read_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="u1" if raw[0] == 1 else "<u4", offset=1).astype(np.int32)


def _fold(c: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups: groups are low bits of the hashes, so rows of the reshaped counts add up."""
    return c.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def _keys(weight, k: int, p: int, q: int):
    """kind 0: a document with its set's size, digest and point; kind 1: a key of a set."""

    def run(batches):
        seen: set[bytes] = set()
        for ids, texts in _batches(batches):
            docs, keys = [], []
            for doc_id, s in zip(ids, shingle_sets(texts, k)):
                n = len(s)
                if not n:
                    docs.append((0, doc_id, 0, None, None, None, None))
                    continue
                key = _digest(s)
                if key in seen:
                    docs.append((0, doc_id, n, key, _short(key), None, None))
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                docs.append((0, doc_id, n, key, _short(key), None, _counts(s)))
                first = n - -(-p * n // q) + 1
                w = weight.value[s >> np.uint64(64 - CELL_BITS)]
                keys.append((_short(key), s[np.lexsort((mix(s), w))[:first]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["kind", "doc_id", "n", "key", "short", "token", "point"])
            if keys:
                token = np.concatenate([t for _, t in keys])
                m = len(token)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, dtype=np.int32)), none, none, pa.nulls(m, pa.binary()),
                     pa.array(np.repeat(np.array([s for s, _ in keys], dtype=np.int64), [len(t) for _, t in keys])), pa.array(token.view(np.int64)), pa.nulls(m, pa.binary())],
                    ["kind", "doc_id", "n", "key", "short", "token", "point"])
    return run


def _groups(batches, by: int):
    """Rows that are sorted by their first ``by`` columns, as one list of rows a group."""
    now, rows = None, []
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for row in zip(*[c.to_pylist() for c in b.slice(at, 512).columns]):
                if row[:by] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[:by], []
                rows.append(row[by:])
    if rows:
        yield now, rows


def _bound_blocks(p: int, q: int):
    """Blocks (token, i, j) of (short, n, point, part) -> spanning links of the bound's graph."""

    def run(batches):
        a, b = [], []
        for (_, i, j), rows in _groups(batches, 3):
            fine = [_read_counts(r[2]) for r in rows]
            points = np.stack([_fold(c, GROUPS) for c in fine])
            sizes = np.array([r[1] for r in rows], dtype=np.int64)
            side = None if i == j else np.array([r[3] for r in rows])

            def allowed(x, y, fine=fine, sizes=sizes):
                groups = min(len(fine[x]), len(fine[y]))
                shared = int(np.minimum(_fold(fine[x], groups), _fold(fine[y], groups)).sum())
                return (p + q) * shared >= p * int(sizes[x] + sizes[y])

            for x, y in spanning_links(points, sizes, p, q, verify=allowed, side=side):
                a.append(rows[x][0])
                b.append(rows[y][0])
            if len(a) > 50_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _sets(bitmap, k: int):
    """The sets of documents whose id is marked, with their digests; a set that recurs in a task is given once."""

    def run(batches):
        marks = bitmap.value
        seen: set[bytes] = set()
        for ids, texts in _batches(batches):
            want = [t for i, t in zip(ids, texts) if i is None or marks[_slot(i) >> 3] >> (_slot(i) & 7) & 1]
            sets = {_digest(s): s for s in shingle_sets(want, k) if len(s)}
            sets = {d: s for d, s in sets.items() if d not in seen}
            if len(seen) >= SEEN:
                seen.clear()
            seen.update(sets)
            yield pa.record_batch([pa.array(list(sets), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["key", "elements"])
    return run


def _read_again(texts: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """(key, elements) with one row for each digest, however many rows repeat an id or have none.
    Rows are dealt by digest, as the join with the plan needs them anyway."""
    return texts.mapInArrow(_sets(_bitmap(member.select("doc_id")), k), "key binary, elements binary").repartition("key").dropDuplicates(["key"])


def _slot(doc_id: int) -> int:
    return ((doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITMAP_BITS)


def _bitmap(ids: DataFrame):
    """A fixed 2 MB bitmap of ids: marked ids are read again, a false mark costs one set."""

    def mark(batches):
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            s = np.unique((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            yield pa.record_batch([pa.array((s >> 5).astype(np.int32)), pa.array(np.int64(1) << (s & 31))], ["word", "bits"])

    words = ids.mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 5), dtype="<u4")
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def _verified_blocks(p: int, q: int):
    """Blocks (cluster, i, j) of (key, elements, part) -> confirmed links that span the components."""

    def run(batches):
        for (_, i, j), rows in _groups(batches, 3):
            sets = [np.frombuffer(r[1], dtype=np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            points = np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
            side = None if i == j else np.array([r[2] for r in rows])
            links = spanning_links(points, sizes, p, q, side=side,
                                   verify=lambda x, y: (p + q) * _overlap(sets[x], sets[y]) >= p * (len(sets[x]) + len(sets[y])))
            yield pa.record_batch([pa.array([rows[x][0] for x, _ in links], pa.binary()), pa.array([rows[y][0] for _, y in links], pa.binary())], ["a", "b"])
    return run


def _sub_blocks(df: DataFrame, parts: str, salt: Column) -> DataFrame:
    """Every row goes to all pairs (i <= j) of sub-blocks that hold its own sub-block ``part``."""
    return (df.withColumn("part", F.pmod(salt, F.col(parts)).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int"))))
            .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, set_key)`` for each row; see the module text.

    Two rows link when ``q * |A and B| >= p * |A or B|`` and both have shingles;
    ``component_id`` is the smallest doc_id reachable by links.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = ids_and_text(docs, id_col, text_col)
    weight = _order_table(texts.select("text"), k)
    rows = saved(texts.mapInArrow(_keys(weight, k, p, q), KEYS), "keys")
    own = rows.where("kind = 0")
    token = rows.where("kind = 1").select("token", "short")
    shared = token.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    held = saved(token.join(shared, "token").distinct(), "held")
    same = (held.groupBy("token").agg(F.bit_xor(F.xxhash64("short")).alias("x"), F.bit_xor(F.xxhash64("short", F.lit(7))).alias("y"), F.count("*").alias("m"))
            .where("m > 1").groupBy("x", "y", "m").agg(F.min("token").alias("token")))
    sets = own.where("point is not null").groupBy("short").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    blocks = held.join(same.select("token", F.ceil(F.col("m") / BLOCK).alias("parts")), "token").join(sets, "short")
    blocks = (_sub_blocks(blocks, "parts", F.xxhash64("short"))
              .select("token", "i", "j", "short", "n", "point", "part").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "short"))
    cluster = saved(components(blocks.mapInArrow(_bound_blocks(p, q), "a long, b long")), "clusters")
    one = own.where("key is not null").groupBy("key", "short", "n").agg(F.min("doc_id").alias("doc_id"))
    member = saved(one.join(cluster.withColumnsRenamed({"node": "short", "root": "cluster"}), "short").select("cluster", "key", "n", "doc_id"), "members")
    size = (member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_ROWS), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).alias("parts"), F.count("*").alias("m"))
            .where("m > 1").drop("m"))
    plan = _sub_blocks(member.join(size, "cluster"), "parts", F.xxhash64("key")).select("cluster", "i", "j", "key", "part")
    blocks = (_read_again(texts, member, k).join(plan, "key")
              .select("cluster", "i", "j", "key", "elements", "part").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key"))
    comp = components(blocks.mapInArrow(_verified_blocks(p, q), "a binary, b binary"))
    # class -> component -> smallest id, then back to the rows
    ids = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = ids.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(least, "root").select("key", "component_id")
    return (own.select("doc_id", F.col("n").alias("n_shingles"), "key").join(label, "key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.col("key").alias("set_key")))


INLINE_IDS = 2_000_000


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inline: int = INLINE_IDS, **options) -> DataFrame:
    """``docs`` without the ids that are copies of a smaller id: of each component the row(s)
    of its smallest id stay. Rows with one id are one document and stay or go together;
    rows without an id stay. The ids that go are sent to all tasks when there are at most
    ``inline`` of them (so no text is shuffled), and joined by a shuffle beyond that."""
    gone = saved(near_duplicates(docs, id_col, text_col, **options).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    gone = gone.select(F.col("doc_id").alias("__gone"))
    few = gone.limit(inline + 1).count() <= inline
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
