"""Vector code compression: product codes from small codebooks, searched by equal averages.

Method: equal-average search. The entries of a codebook are sorted by the sum of their
components. By the Cauchy-Schwarz inequality two vectors of ``m`` components are at a
squared distance of at least (gap of their sums)^2 / m, so the search begins at the
entries whose sums are nearest to the part's own, expands outward, and ends when that
bound strictly exceeds the best distance: all ties have been seen by then, and the
result is that of a full search. A batch of parts is searched at once, those that are
done drop out.

Components become integers, ``floor(SCALE * x)``, so every sum and distance is exact and
does not depend on how the rows are spread. The integer vectors are written once; a
round reads them, assigns every part and sends ``parts * entries`` partial sums a task
through a grouped sum to the driver (entries * dimension numbers, whatever the table).

Defined cases: vectors that are null or hold null or non-finite components go. So do
vectors that cannot be cut like the others: empty ones, lengths that ``parts`` does not
divide, and lengths other than the most frequent of the rest (ties: the shorter). Rows
that repeat an id are rows of their own, by id and then by components; rows without an
id come last, so they begin a codebook only where fewer than ``entries`` ids are there.
Fewer rows than ``entries`` give shorter codebooks. Null labels are one label. Components
beyond 2^27 after scaling raise an error, as their distances would not be exact.
Other columns are not read; there are no texts. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import saved, ship

SCALE = 4096
LARGEST = 1 << 27
ROWS = 4096  # rows searched at once


def equal_average_search(x: np.ndarray, entries: np.ndarray, looked: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of ``x``, ties to the lower index;
    ``looked`` collects how many distances each step computed."""
    n, m = x.shape
    k = len(entries)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums, by_sum = entries.sum(axis=1)[order], entries[order]
    own = x.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, k, dtype=np.int64)
    far = np.int64(1) << 40  # beyond any gap of sums
    live = np.arange(n)
    while len(live):
        lo, hi, s = left[live], right[live], own[live]
        gap_lo = np.where(lo >= 0, s - sums[np.maximum(lo, 0)], far)
        gap_hi = np.where(hi < k, sums[np.minimum(hi, k - 1)] - s, far)
        down = gap_lo <= gap_hi
        gap = np.where(down, gap_lo, gap_hi)
        # the bound gap^2 / m > best, without a division; the first entry is always looked at
        on = (gap < far) & ((index[live] == k) | (gap * gap <= np.minimum(best[live], np.iinfo(np.int64).max // m) * m))
        live, down = live[on], down[on]
        if looked is not None:
            looked.append(len(live))
        at = np.where(down, left[live], right[live])
        d = ((x[live] - by_sum[at]) ** 2).sum(axis=1)
        found = order[at]
        better = (d < best[live]) | ((d == best[live]) & (found < index[live]))
        best[live] = np.where(better, d, best[live])
        index[live] = np.where(better, found, index[live])
        left[live] -= down
        right[live] += ~down
    return index, best


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1)


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes and distances for books of shape (parts, entries, width)."""
    parts, _, width = books.shape
    found = [equal_average_search(x[:, p * width:(p + 1) * width], books[p]) for p in range(parts)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _sums(model):
    """Task -> one row for each part, entry and position that it used: sum and count."""

    def run(batches):
        books = model.value
        parts, k, width = books.shape
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for b in _slices(batches):
            x = _matrix(b.column(0))
            index, _ = _assigned(x, books)
            for p in range(parts):
                np.add.at(total[p], index[:, p], x[:, p * width:(p + 1) * width])
                count[p] += np.bincount(index[:, p], minlength=k)
        p, e = np.nonzero(count)
        cell = np.repeat(p * k + e, width)
        yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
                               pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], width))], ["cell", "place", "total", "n"])
    return run


def _codes(model):
    def run(batches):
        books = model.value
        for b in _slices(batches):
            index, d = _assigned(_matrix(b.column(2)), books)
            code = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(d.sum(axis=1))], ["vec_id", "label", "code", "error"])
    return run


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each kept row; see the module text.

    ``code`` holds an entry's index for each part (two hex digits, so at most 256 entries),
    ``error`` the squared distance to the coded vector in scaled integers, ``label_error`` the
    sum of the errors of all rows with that label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kind = v.schema["label"].dataType.simpleString()
    fine = (F.size("v") > 0) & (F.size("v") % parts == 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False)))
    dims = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"))
    top = dims.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    dim, _, most = top
    if most * SCALE >= LARGEST:
        raise ValueError(f"a component of {most} is beyond {LARGEST // SCALE}")
    v = v.where(F.size("v") == dim).select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("x"))
    v = saved(v, "vectors")
    first = np.array([r.x for r in v.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(books)
        new = (v.select("x").mapInArrow(_sums(model), "cell int, place int, total long, n long")
               .groupBy("cell", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas())
        books = books.copy()
        cell, place = new["cell"].to_numpy(dtype=np.int64), new["place"].to_numpy(dtype=np.int64)
        books[cell // len(first), cell % len(first), place] = new["total"].to_numpy(dtype=np.int64) // new["n"].to_numpy(dtype=np.int64)
        model.destroy()
    model = spark.sparkContext.broadcast(books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = saved(v.mapInArrow(_codes(model), f"vec_id long, label {kind}, code string, error long"), "codes")
    # written, so that its size decides how it is joined: sent to all tasks only where it is small
    sums = saved(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
            .select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same result in DuckDB, by full search; needs vectors of one length and at least ``entries`` rows."""
    assign = """a{r} AS (SELECT p.row, p.part, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e.entry) AS best
      FROM p JOIN e{r} e ON p.part = e.part GROUP BY p.row, p.part)"""
    renew = """m{n} AS (SELECT part, best % 256 AS entry, place, sum(x[place])::BIGINT AS s, count(*) AS n
      FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS place) GROUP BY part, best % 256, place),
    e{n} AS (SELECT e.part, e.entry, coalesce(any_value(m.x), any_value(e.x)) AS x FROM e{r} e LEFT JOIN
      (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM m{n} GROUP BY part, entry) m ON e.part = m.part AND e.entry = m.entry GROUP BY e.part, e.entry)"""
    steps = []
    for r in range(rounds + 1):
        steps.append(assign.format(r=r))
        if r < rounds:
            steps.append(renew.format(r=r, n=r + 1))
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT row, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
    e0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {entries}),
    {", ".join(steps)},
    b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
    c AS (SELECT row, string_agg(printf('%02x', (best % 256)::INTEGER), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY row)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (row), b"""
