"""Conversation prefix trie: how much text conversations that begin alike could share.

Method: time-forward processing. The conversations, as sequences of turn digests, are range
partitioned and sorted, so a shard is a stretch of the trie in path order. One scan of a
shard creates its nodes with their members' count and smallest id; Spark's external sort
puts them in reverse level order; then one pass takes each node, pops what its children
sent, and sends the node's own subtree totals on to its parent through a priority queue that
spills sorted runs to disk, so memory does not follow the width of a level. A child's row
rides along and leaves the queue with its parent's id.

Only the paths of a shard's first and last conversation can go on in other shards. The nodes on
them, the shard's roots, are set aside with partial totals (at most twice the depth a
shard, however many conversations a node has); they are summed by digest, and the same
pass runs once more over the tree of these roots.

Because equal paths may be cut between shards too, a first turn, or a whole conversation, that a
third of all rows share is spread like any other. A digest of many member ids is
built from pieces in order, so no task holds them all. Texts are hashed (128 bits of
role and text) before anything is shuffled. A single conversation is one row of a task: 20
bytes a turn.

Defined cases: rows without a conv_id go; null role or text counts as empty; turns go by turn,
null first, ties by role and then by digest; repeated rows are turns of their own; the base of a
negative id is the next multiple of ``every`` at or below it; long texts are hashed whole; other
columns are not read; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved, ship

PIECE = 1 << 16  # member ids in one piece of an end digest's input
HELD = 200_000  # messages that a queue holds in memory
OUT_ROWS = 4096
NODES = ("shard long, key binary, parent binary, root boolean, digest binary, above binary, depth long, conv_id long, n_convs long, words long, "
         "children long, leaves long, saved long, ends string, kind int, piece long, text string")
ROWS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest binary, above binary"


class SpillingQueue:
    """Smallest key first; beyond ``held`` messages the queue's content goes to disk as a sorted run.
    A run is a task's own unnamed scratch file, gone when the task ends."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.n, self.spilled = held, [], [], 0, 0

    def push(self, key, message) -> None:
        self.n += 1
        heapq.heappush(self.heap, (key, self.n, message))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        self.heap.sort()
        for x in self.heap:
            pickle.dump(x, run, protocol=pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        self.spilled += len(self.heap)
        self.heap = []
        self.runs.append([pickle.load(run), run])
        heapq.heapify(self.runs)  # heads differ in their second place, so files are never compared

    def pop_all(self, key) -> Iterator:
        """Every message sent to ``key``; messages to smaller keys must have been taken before."""
        while True:
            from_run = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
            if not from_run and not self.heap:
                return
            head = self.runs[0][0] if from_run else self.heap[0]
            if head[0] != key:
                return
            if from_run:
                try:
                    heapq.heapreplace(self.runs, [pickle.load(self.runs[0][1]), self.runs[0][1]])
                except EOFError:
                    heapq.heappop(self.runs)[1].close()
            else:
                heapq.heappop(self.heap)
            yield head[2]


def _table(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_KIND = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KIND[f.split()[1]]) for f in text.split(", ")])


class _Node:
    __slots__ = ("key", "conv", "n", "words", "ends", "pieces", "first")

    def __init__(self, key: int, words: int, first: bool):
        self.key, self.conv, self.n, self.words, self.ends, self.pieces, self.first = key, None, 0, words, [], 0, first


def _digests(path: list[bytes]) -> list[bytes]:
    """Digest of each prefix, from the empty one on."""
    out = [hashlib.blake2b(b"", digest_size=16).digest()]
    for turn in path:
        out.append(hashlib.blake2b(out[-1] + turn, digest_size=16).digest())
    return out


def scan(rows: Iterator[tuple[list[bytes], list[int], int]], shard: int, piece: int = PIECE) -> Iterator[tuple]:
    """(path, words of its turns, id) in order of path and id -> rows of NODES: nodes (kind 0) and pieces
    of end digests (kind 1). Nodes are numbered in path order, children after their parent."""
    open_: list[_Node] = []
    before: list[bytes] = []
    count = 0

    def cut(node: _Node, depth: int, digest: bytes) -> tuple:
        text = ",".join(map(str, node.ends))
        node.ends = []
        node.pieces += 1
        return (shard, None, None, None, digest, None, depth, None, None, None, None, None, None, None, 1, node.pieces, text)

    def close(depth: int, last: bool, digest: list[bytes] | None) -> Iterator[tuple]:
        node = open_.pop()
        root = last or node.first
        if root or node.pieces:
            if digest is None:
                digest = _digests(before)
            if node.ends:
                yield cut(node, depth, digest[depth])
        up = open_[-1] if open_ else None
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        pieced = node.pieces > 0
        ends = None if root or pieced else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        yield (shard, node.key.to_bytes(8, "big"), None if up is None else up.key.to_bytes(8, "big"), root, digest[depth] if root or pieced else None,
               digest[depth - 1] if root and depth else None, depth, node.conv, node.n, node.words, 0, 0, 0, ends, 0, 0, None)

    for path, words, conv in rows:
        shared = 0
        most = min(len(path), len(before))
        while shared < most and path[shared] == before[shared]:
            shared += 1
        first = not open_
        if first:
            open_.append(_Node(count, 0, True))
            count += 1
        chain = None
        while len(open_) - 1 > shared:
            if chain is None and (open_[-1].first or open_[-1].pieces):
                chain = _digests(before)
            yield from close(len(open_) - 1, False, chain)
        for d in range(len(open_) - 1, len(path)):
            open_.append(_Node(count, words[d], first))
            count += 1
        before = path
        node = open_[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends.append(conv)
        if len(node.ends) >= piece:
            yield cut(node, len(path), _digests(path)[-1])
    if open_:
        chain = _digests(before)
        while open_:
            yield from close(len(open_) - 1, True, chain)


def _scan(piece: int):
    def run(batches):
        schema, shard = _schema(NODES), TaskContext.get().partitionId()

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*[c.to_pylist() for c in b.slice(at, 256).columns])
        held = []
        for row in scan(rows(), shard, piece):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield _table(held, schema)
                held = []
        yield _table(held, schema)
    return run


def forward(nodes: Iterator[tuple], queue: SpillingQueue) -> Iterator[tuple]:
    """Rows (shard, key, parent, root, digest, above, depth, conv_id, n_convs, words, children, leaves, saved, ends)
    in order of shard, depth (greatest first) and key -> (True, partial row of a root) or (False, row of ROWS).

    A message goes to (shard, -depth, key) of the parent, which is after the sender in that order."""
    for shard, key, parent, root, digest, above, depth, conv, n, words, children, leaves, saved_, ends in nodes:
        for row, leaves_below, saved_below in queue.pop_all((shard, -depth, key)):
            children += 1
            leaves += leaves_below
            saved_ += saved_below
            # a root's id is not known before the other shards have spoken
            yield False, (*row[:2], None if root else conv, *row[2:], digest if root else None)
        if root:
            yield True, (digest, above, depth, conv, n, words, children, leaves, saved_)
            continue
        if not children:
            leaves = 1
        saved_ += (n - 1) * words
        row = (conv, depth, n, children, leaves, saved_, ends, digest)
        if parent is None:
            yield False, (*row[:2], None, *row[2:], None)
        else:
            queue.push((shard, 1 - depth, parent), (row, leaves, saved_))


BOTH = f"root boolean, {ROWS}, words long"


def _forward(held: int):
    """The pass over the nodes of a task's shards; partial totals of the shards' roots are marked."""

    def run(batches):
        schema = _schema(BOTH)
        queue = SpillingQueue(held)

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    yield from zip(*[c.to_pylist() for c in b.slice(at, 1024).columns])
        out = []
        for is_root, row in forward(rows(), queue):
            if is_root:
                digest, above, depth, conv, n, words, children, leaves, saved_ = row
                out.append((True, conv, depth, None, n, children, leaves, saved_, None, digest, above, words))
            else:
                out.append((False, *row, None))
            if len(out) >= OUT_ROWS:
                yield _table(out, schema)
                out = []
        yield _table(out, schema)
    return run


def rebuilt(turns: DataFrame, every: int = 20) -> DataFrame:
    """conv_id, path (digests of the turns), words (of the turns) of each conversation: the first
    ``crc32(conv_id) % 4`` turns of the conversation that ``every`` ids share, then its own turns after as many."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    t = t.select("conv_id", "turn", "role", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
                 F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    own = saved(t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("turns"))
                .select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns")), "conversations")
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    none = F.array().cast("array<struct<digest:binary,words:int>>")
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return (own.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).withColumn("h", h).join(base, "base", "left").withColumn("whole", whole)
            .select(F.col("whole.digest").alias("path"), F.col("whole.words").alias("words"), "conv_id"))


def _end_digests(batches):
    """Pieces (digest, text) in order of the digest and their place -> (digest, sha256 of the joined texts)."""
    now, h, out = None, None, []
    for b in batches:
        for digest, text in zip(b.column(0).to_pylist(), b.column(1)):
            if digest != now:
                if now is not None:
                    out.append((now, h.hexdigest()))
                now, h = digest, hashlib.sha256(text.as_py().encode())
            else:
                h.update(b"," + text.as_py().encode())
    if now is not None:
        out.append((now, h.hexdigest()))
    yield _table(out, _schema("digest binary, ends string"))


def trie(conversations: DataFrame, every: int = 20, held: int = HELD, piece: int = PIECE) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see the module text and ``rebuilt``."""
    ship(conversations.sparkSession)
    paths = saved(rebuilt(conversations, every), "paths")
    shards = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    scanned = saved(shards.mapInArrow(_scan(piece), NODES), "nodes")
    pieces = (scanned.where("kind = 1").select("digest", "text", "shard", "piece").repartition("digest").sortWithinPartitions("digest", "shard", "piece").select("digest", "text"))
    ends = saved(pieces.mapInArrow(_end_digests, "digest binary, ends string"), "ends")
    columns = ["shard", "key", "parent", "root", "digest", "above", "depth", "conv_id", "n_convs", "words", "children", "leaves", "saved", "ends"]
    nodes = scanned.where("kind = 0").select(*columns).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
    first = saved(nodes.mapInArrow(_forward(held), BOTH), "within-shards")
    # across shards: at most twice the depth rows a shard
    roots = (first.where("root").groupBy("digest").agg(F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                                                       F.min("words").alias("words"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
                                                       F.sum("saved_tokens").alias("saved")))
    roots = roots.select(F.lit(0).cast("long").alias("shard"), F.col("digest").alias("key"), F.col("above").alias("parent"), F.lit(False).alias("root"), "digest",
                         "above", "depth", "conv_id", "n_convs", "words", "children", "leaves", "saved", F.lit(None).cast("string").alias("ends"))
    second = saved(roots.repartition(1).sortWithinPartitions("shard", F.desc("depth"), "key").mapInArrow(_forward(held), BOTH).drop("root", "words"), "across-shards")
    inner = first.where("not root").drop("root", "words")
    parents = second.select(F.col("digest").alias("above"), F.col("conv_id").alias("__parent"))
    below = inner.where("above is not null").join(parents, "above").withColumn("parent_conv_id", F.col("__parent")).drop("__parent")
    rows = inner.where("above is null").unionByName(below).unionByName(second)
    none = hashlib.sha256(b"").hexdigest()
    late = (rows.where("ends_sha256 is null").join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).drop("ends"))
    return (rows.where("ends_sha256 is not null").unionByName(late)
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def oracle_sql() -> str:
    """The same result in DuckDB; needs turns without repeats in a conversation."""
    crc = "(SELECT n AS i, n AS c0 FROM (SELECT unnest(range(256))::BIGINT AS n))"
    for i in range(8):
        crc = f"(SELECT i, CASE WHEN c{i} % 2 = 1 THEN xor(c{i} // 2, 3988292384) ELSE c{i} // 2 END AS c{i + 1} FROM {crc})"
    return f"""WITH tab AS (SELECT list(c8 ORDER BY i) AS tab FROM {crc}),
    own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 4 AS h FROM own, tab),
    whole AS (SELECT h.conv_id, list_concat(coalesce(base.turns[1:h], []), h.turns[h + 1:]) AS path FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - (h.conv_id % 20 + 20) % 20),
    member AS (SELECT conv_id, path, len(path) AS size, d AS depth, path[1:d] AS prefix FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM whole)),
    node AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix[depth].t), '[^\x20\x09-\x0D]+')) END AS words,
      sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM member GROUP BY prefix, depth),
    child AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
    below AS (SELECT n.prefix[1:up] AS top, sum(CASE WHEN child.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS up FROM node) n LEFT JOIN child ON child.prefix = n.prefix GROUP BY top)
    SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, below.n_leaves::BIGINT AS n_leaves,
      below.saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
    FROM node JOIN below ON below.top = node.prefix LEFT JOIN child ON child.prefix = node.prefix LEFT JOIN node parent ON node.depth > 0 AND parent.prefix = node.prefix[1:node.depth - 1]"""
