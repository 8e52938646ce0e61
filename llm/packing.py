"""Packing of tokenized documents into windows of a fixed length.

Method: Karmarkar-Karp multiway differencing. A document's full windows stand alone;
the remainders of a group of documents start as partial partitions of one item each,
and the two partial partitions with the largest spread are merged again and again,
the fullest windows of one with the emptiest of the other, until one partition into
near-equal windows is left. The window count starts at the least possible and rises
when a window exceeds the capacity; where the rise would leave more padding than
``max_padding``, the excess of an over-full window is cut off instead and fills the
windows that still have room.

A group is what one task reads next (``GROUP`` documents), so nothing is shuffled and
memory does not follow the table or a document's length beyond its own ids. Which
windows a document shares depends on the order of the input's rows alone. Spark reads
the files of a table in an order of its own, so where the order of a written table
matters ``run`` names the run of rows (a file, or the part of it that one task reads)
that a row belongs to: no group spans two runs, and sequences are numbered from 0 by
run and then by group, so their numbers follow the table's order.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed
as rows of their own; a null id stays null; other columns are not read; an empty
table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import saved, ship

GROUP = 2048
ROWS = 64  # texts that are tokenized at once
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: items into ``k`` windows of near-equal sums (lists of item numbers).

    A partial partition is its non-empty windows, (-sum, window) ascending, so the
    fullest comes first; windows it lacks are empty. Window contents are joined by
    reference and read out at the end.
    """
    if k <= 1:
        return [list(range(len(sizes)))] if sizes else []
    tree: list = list(range(len(sizes)))  # an item number, or a pair of earlier windows
    heap = [(-s, i, [(-s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        meet = len(a) + len(b) - k
        if meet > 0:
            # the emptiest windows of a meet the emptiest of b in opposite order
            low = a[len(a) - meet:]
            joined = []
            for (x, i), (y, j) in zip(low, reversed(b[len(b) - meet:])):
                tree.append((i, j))
                joined.append((x + y, len(tree) - 1))
            b = b[:len(b) - meet]
            del a[len(a) - meet:]
            b = joined + b
        if len(b) <= 4:
            for w in b:
                insort(a, w)
        else:
            a = sorted(a + b)
        spread = a[0][0] - (a[-1][0] if len(a) == k else 0)
        heapq.heappush(heap, (spread, count, a))
        count += 1
    out = []
    for _, w in heap[0][2]:
        items, todo = [], [w]
        while todo:
            x = tree[todo.pop()]
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def windows_of(sizes: list[int], capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) pieces, none over ``capacity``; see the module text."""
    total = sum(sizes)
    if not total:
        return []
    k = -(-total // capacity)
    most = max(k, int(total / (capacity * (1 - max_padding))))
    found = difference(sizes, k)
    if k < most and max(sum(sizes[i] for i in w) for w in found) > capacity:
        k = most
        found = difference(sizes, k)
    windows = [[(i, 0, sizes[i]) for i in w] for w in found] + [[] for _ in range(k - len(found))]
    used = [sum(n for _, _, n in w) for w in windows]
    spare = []
    for w, n in enumerate(used):
        over = n - capacity
        while over > 0:
            item, start, length = windows[w].pop()
            cut = min(over, length)
            spare.append((item, start + length - cut, cut))
            if length > cut:
                windows[w].append((item, start, length - cut))
            over -= cut
        used[w] = min(n, capacity)
    room = [w for w in range(k) if used[w] < capacity]
    for item, start, length in spare:
        while length:
            w = room[-1]
            cut = min(length, capacity - used[w])
            windows[w].append((item, start, cut))
            used[w] += cut
            start, length = start + cut, length - cut
            if used[w] == capacity:
                room.pop()
    return [w for w in windows if w]


def _pack(path: str, capacity: int, end_id: int, max_padding: float, group: int):
    def packed(batches):
        from llm.bpe import encoder
        encode = encoder(path).encode
        end = int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows: list[list] = [[] for _ in range(8)]
        run = None
        rest: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids

        def put(doc_id, start, ids, total, offset):
            for column, v in zip(rows, (doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, run)):
                column.append(v)

        def out():
            batch = pa.record_batch([pa.array(c, pa.int64()) for c in rows[:7]] + [pa.array(rows[7], pa.string())],
                                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "run"])
            for c in rows:
                c.clear()
            return batch

        def close_group():
            nonlocal sequence
            for w in windows_of([len(ids) // 4 for *_, ids in rest], capacity, max_padding):
                offset = 0
                for i, start, length in w:
                    doc_id, first, total, ids = rest[i]
                    put(doc_id, first + start, ids[4 * start:4 * (start + length)], total, offset)
                    offset += length
                sequence += 1
            rest.clear()

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for doc_id, ids, at_run in zip(*[c.to_pylist() for c in part.columns]):
                    if at_run != run:
                        close_group()
                        run = at_run
                    ids = encode(ids or "") + end
                    total = len(ids) // 4
                    full = total - total % capacity
                    for start in range(0, full, capacity):
                        put(doc_id, start, ids[4 * start:4 * (start + capacity)], total, 0)
                        sequence += 1
                    if full < total:
                        rest.append((doc_id, full, total, ids[4 * full:]))
                    if len(rest) >= group:
                        close_group()
                    if len(rows[0]) >= 20_000:
                        yield out()
        close_group()
        yield out()
    return packed


def file_runs(docs: DataFrame) -> Column | None:
    """The run of each row of a table as Spark wrote it: file by file in the order of the tasks that wrote them, and
    by the place of a split in its file. None where rows do not come straight from files."""
    name, at = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    run = F.concat_ws("/", F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0"), name, F.lpad(at.cast("string"), 20, "0"))
    try:
        docs.select(run)
    except AnalysisException:
        return None
    return run


def _numbered(pieces: DataFrame) -> DataFrame:
    """Sequences numbered from 0 by run and then as they are in it. The pieces (no texts) are
    written; the running sum over runs is one small table, a row for each split that was read."""
    pieces = saved(pieces, "pieces")
    last = pieces.groupBy("run").agg(F.min("sequence_id").alias("first"), (F.max("sequence_id") - F.min("sequence_id") + 1).alias("n"))
    base = last.select("run", (F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - F.col("first")).alias("shift"))
    return pieces.join(base, "run").withColumn("sequence_id", F.col("sequence_id") + F.col("shift")).drop("run", "shift")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, max_padding: float = 0.004, group: int = GROUP,
         id_col: str = "doc_id", text_col: str = "text", run: Column | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the vocabulary file ``tokenizer`` and then ``end_id``;
    every id lies in exactly one piece, a sequence's pieces fill it gaplessly from 0.
    ``run`` (see the module text) orders the sequences; the rows of a run lie in one task.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None).cast("string") if run is None else run).alias("run"))
    pieces = read.mapInArrow(_pack(tokenizer, capacity, end_id, max_padding, group), f"{PIECES}, run string")
    return pieces.drop("run") if run is None else _numbered(pieces)
