"""Approximate nearest neighbours by inner product, over balanced posting lists.

Method: centroids come from balanced bisection of a bounded sample (``FIT`` vectors with
the smallest id hash), so that posting lists are of near-equal size; a vector near the
boundary of several clusters stands in each of them (up to ``copies`` lists within
``boundary`` times its least distance). A query walks an in-memory graph over the
centroids (nearest neighbours plus a few fixed random links) and keeps the lists whose
distance is at most ``probe`` times the least, and the nearest ``share`` of all lists at
least: on vectors without clusters the ratio alone ends the walk far too early (the
README has the figures). Lists and queries meet in Spark twice. The ``first`` nearest
lists give each query ``k`` vectors, and the last of these a bound; of the other lists
only vectors at or above that bound leave a task, so what is moved and merged follows the
result and not the number of lists asked.

Largest inner product becomes least distance by one more coordinate,
``sqrt(M^2 - |x|^2)`` with ``M`` the largest norm (0 for a query). Distances only choose
lists; scores are inner products of the original vectors in double precision.

All rows are indexed. There are at most ``MAX_LISTS`` lists, so centroids and graph
stay small; a list longer than a block, or asked by more queries than a block, is cut
into blocks that are worked on separately, none is capped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite values,
rows without an id and vectors whose length is not the most frequent one (ties: the
shorter) take no part; there are no texts, and other columns, clashing names among them, are
not read; rows with one id count as one candidate with the best score,
as a query the smallest of their vectors asks; fewer than ``k`` candidates give fewer
rows; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.common import hash_sample, saved, ship

FIT = 20_000
LIST_ROWS = 512
MAX_LISTS = 4096
BLOCK_VALUES = 2_000_000  # numbers in one block's vectors
DEGREE, LONG_LINKS = 16, 4
ENTRIES = 512  # clusters far apart have no links between them, so walks begin all over the centroids


def bisect(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Centroids of ``lists`` groups of near-equal size, by repeated two-means with halves of
    fixed sizes."""
    rng = np.random.default_rng(seed)
    todo, out = [(np.arange(len(x)), lists)], []
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            continue
        p = x[rows]
        a = p[rng.integers(len(p))]
        b = p[np.argmax(((p - a) ** 2).sum(axis=1))]
        cut = len(rows) * (n // 2) // n
        for _ in range(8):
            order = np.argsort(p @ (a - b) - (a @ a - b @ b) / 2, kind="stable")
            b, a = p[order[:cut]].mean(axis=0), p[order[cut:]].mean(axis=0)
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    return np.stack(out)


class CentroidGraph:
    """Nearest-neighbour graph over centroids; walked for many queries at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.c = centroids
        self.sq = (centroids ** 2).sum(axis=1)
        n = len(centroids)
        links = []
        for at in range(0, n, 256):
            d = self.sq - 2 * centroids[at:at + 256] @ centroids.T
            near = min(n, DEGREE + 1)
            links.append(np.argpartition(d, near - 1, axis=1)[:, :near])
        far = np.random.default_rng(seed).integers(0, n, size=(n, LONG_LINKS))
        self.links = np.concatenate([np.concatenate(links), far], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))

    def search(self, q: np.ndarray, probe: float, least_lists: int) -> list[np.ndarray]:
        """For each query the lists within ``probe`` times the least distance found, nearest first."""
        n, m = len(self.c), len(q)
        own = (q ** 2).sum(axis=1)
        dist = np.full((m, n), np.inf)
        opened = np.zeros((m, n), dtype=bool)
        dist[:, self.entry] = np.sqrt(np.maximum(0, own[:, None] + self.sq[self.entry] - 2 * q @ self.c[self.entry].T))
        least = min(least_lists, n)
        live = np.arange(m)
        while len(live):
            d = dist[live]
            bound = np.maximum(probe * d.min(axis=1), np.partition(d, least - 1, axis=1)[:, least - 1])
            d[opened[live]] = np.inf
            nxt = d.argmin(axis=1)
            go = d[np.arange(len(live)), nxt] <= bound
            go &= np.isfinite(d[np.arange(len(live)), nxt])
            live, nxt = live[go], nxt[go]
            if not len(live):
                break
            opened[live, nxt] = True
            near = self.links[nxt]
            new = np.sqrt(np.maximum(0, own[live, None] + self.sq[near] - 2 * np.einsum("ijk,ik->ij", self.c[near], q[live])))
            dist[live[:, None], near] = new
        out = []
        for i in range(m):
            order = np.argsort(dist[i], kind="stable")
            d = dist[i, order]
            stay = np.isfinite(d) & ((d <= probe * d[0]) | (np.arange(n) < least))
            out.append(order[stay])
        return out


def _matrix(column, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most * most - (x ** 2).sum(axis=1)))[:, None]], axis=1)


def _assign(model, dim: int, copies: int, boundary: float):
    def run(batches):
        centroids, most = model.value
        sq = (centroids ** 2).sum(axis=1)
        near = min(copies, len(centroids))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _lifted(_matrix(part.column(1), dim), most)
                d = np.sqrt(np.maximum(0, (x ** 2).sum(axis=1)[:, None] + sq - 2 * x @ centroids.T))
                pick = np.argpartition(d, near - 1, axis=1)[:, :near]
                dd = np.take_along_axis(d, pick, axis=1)
                row, col = np.nonzero(dd <= boundary * dd.min(axis=1)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(pick[row, col], pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))],
                                                 ["list", "vec_id", "v"])
    return run


def _probe(model, dim: int, probe: float, share: float, least_lists: int):
    """Queries -> a row for each list to ask, with its place among them (nearest first)."""

    def run(batches):
        centroids, _ = model.value
        graph = CentroidGraph(centroids)
        least = max(least_lists, math.ceil(share * len(centroids)))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = _matrix(part.column(1), dim)
                found = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), probe, least)
                row = pa.array(np.repeat(np.arange(len(q)), [len(f) for f in found]))
                place = pa.array(np.concatenate([np.arange(len(f)) for f in found]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int32()), place, part.column(0).take(row), part.column(1).take(row)],
                                                 ["list", "place", "query_id", "q"])
    return run


def _best(dim: int, k: int):
    """One block of a list against one block of its queries -> each query's k best at or above its bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left["vec_id"].to_numpy(), _matrix(left["v"], dim)
        queries, q, bound = right["query_id"].to_numpy(), _matrix(right["q"], dim), right["bound"].to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ids) and len(queries):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            again = int((ids[1:] == ids[:-1]).sum())  # rows that repeat an id take no place
            for at in range(0, len(queries), 128):
                s = q[at:at + 128] @ x.T
                for i, row in enumerate(s):
                    query = queries[at + i]
                    want = min(len(row), k + 1 + again)  # one more: the query itself may be there
                    least = max(np.partition(row, len(row) - want)[len(row) - want], bound[at + i])
                    pick = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
                    pick = pick[ids[pick] != query]
                    score = (x[pick] * q[at + i]).sum(axis=1)
                    pick, score = pick[score >= bound[at + i]], score[score >= bound[at + i]]
                    first = np.lexsort((ids[pick], -score))
                    if again:
                        first = first[np.sort(np.unique(ids[pick][first], return_index=True)[1])]
                    first = first[:k]
                    out[0].append(np.full(len(first), query))
                    out[1].append(ids[pick][first])
                    out[2].append(score[first])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})
    return run


def _blocks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(list, own): number of blocks of at most about ``rows`` rows a list."""
    return df.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias(key))


def _meet(posting: DataFrame, ask: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the lists' vectors at or above the bounds of the queries that ask them."""
    block = max(64, BLOCK_VALUES // dim)
    parts = F.broadcast(_blocks(posting, "xs", block).join(_blocks(ask, "qs", block), "list"))  # at most MAX_LISTS rows
    left = (posting.join(parts, "list").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("xs")).cast("int"))
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("list", "x", "y", "vec_id", "v"))
    right = (ask.join(parts, "list").withColumn("y", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int"))
             .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1))).select("list", "x", "y", "query_id", "q", "bound"))
    return left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(_best(dim, k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    merged = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, copies: int = 4, boundary: float = 1.15, probe: float = 1.05, share: float = 0.2, least_lists: int = 8,
            first: int = 4, list_rows: int = LIST_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = (F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    v = v.where(F.coalesce(fine, F.lit(False)))
    dims = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("most"))
    top = dims.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], empty)
    dim, n, most = top
    v = v.where(F.size("v") == dim)
    lists = min(MAX_LISTS, max(1, -(-n // list_rows)))
    rows = hash_sample(v, FIT, 29).select("v").toArrow()
    model = spark.sparkContext.broadcast((bisect(_lifted(_matrix(rows["v"], dim), most), lists), most))
    kind = vectors.schema[vector_col].dataType.simpleString()
    posting = saved(v.mapInArrow(_assign(model, dim, copies, boundary), f"list int, vec_id long, v {kind}"), "postings")
    ask = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("q"))
    ask = saved(ask.mapInArrow(_probe(model, dim, probe, share, least_lists), f"list int, place int, query_id long, q {kind}"), "probes")
    near = ask.where(F.col("place") < first).withColumn("bound", F.lit(float("-inf")))
    found = saved(_ranked(_meet(posting, near, dim, k), k), "first")
    bound = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    rest = ask.where(F.col("place") >= first).join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    return _ranked(found.drop("rank").unionByName(_meet(posting, rest, dim, k)), k)
