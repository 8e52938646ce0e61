"""Quality classifier: importance resampling towards a target text.

Method: two generative models over hashed n-grams (words and word pairs in ``BUCKETS``
buckets), one of the target text and one of the raw text; a document's log importance
is the log ratio of the two, per n-gram and scaled to ``UNIT`` n-grams so that length does
not decide. Documents are drawn without replacement with these weights by Gumbel top-k:
a fixed hash of the row gives its Gumbel noise, and the ``k`` largest sums stay.

The labelled rows are dealt into two halves by an id hash. The raw model counts all
documents. The target model counts the documents of the first half that are labelled
good and not toxic, at most ``TARGET_DOCS`` of them (a bounded sample: the smallest id
hashes). Without a given share, ``k`` is set from all rows of the second half, which the
model has not learned: the number of documents above the sum that keeps at least
``keep_good`` of the good rows and rejects most of the bad ones; without such labels
all documents with words are kept.

Defined cases: null, empty and word-less texts have no weight and are not kept; one
word has no pair; rows tied with the last one drawn are all kept, so repeated rows get
one verdict; null ids are kept as ids; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import hash_sample, ids_and_text, saved, ship
from llm.quality_rules import pick_threshold
from llm.wordhash import batch_hashes, windows

BUCKETS = 10_000
UNIT = 64
TARGET_DOCS = 50_000
SMOOTH = 1.0


def _ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, number of the text it is from), pairs after words."""
    words, n = batch_hashes(texts, lower=True)
    own = np.repeat(np.arange(len(texts)), n)
    pairs = windows(words, 2)
    same = own[1:] == own[:-1] if len(own) > 1 else np.zeros(0, dtype=bool)
    grams = np.concatenate([words, pairs[same]]) if len(pairs) else words
    return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([own, own[1:][same]]) if len(pairs) else own


def _models(target):
    """Counts of each bucket in the raw and the target text of a task."""

    def run(batches):
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                bucket, own = _ngrams(part.column(1).to_pylist())
                raw += np.bincount(bucket, minlength=BUCKETS)
                ids = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                chosen = np.isin(ids, target.value) & part.column(0).is_valid().to_numpy(zero_copy_only=False)
                good += np.bincount(bucket[chosen[own]], minlength=BUCKETS) if len(own) else 0
        yield pa.record_batch([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(raw), pa.array(good)], ["bucket", "raw", "good"])
    return run


def _weigh(ratio):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                bucket, own = _ngrams(part.column(1).to_pylist())
                n = np.bincount(own, minlength=part.num_rows)
                total = np.bincount(own, weights=ratio.value[bucket], minlength=part.num_rows) if len(own) else np.zeros(part.num_rows)
                weight = UNIT * total / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(weight, mask=n == 0)], ["doc_id", "n_ngrams", "log_weight"])
    return run


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, smoothed by ``SMOOTH`` counts a bucket."""
    if not good.sum():
        return np.zeros(len(raw))
    p = (good + SMOOTH) / (good.sum() + SMOOTH * len(good))
    q = (raw + SMOOTH) / (raw.sum() + SMOOTH * len(raw))
    return np.log(p) - np.log(q)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, exactly, by narrowing histograms: each round counts
    ``bins`` intervals and goes on in the one that holds the rank."""
    df = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    lo, hi, n = df.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return lo
    left = k
    while lo < hi:
        width = (hi - lo) / bins
        if not lo + width > lo:
            break
        inside = df.where(F.col("x").between(lo, hi))
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width)).cast("int")
        counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(counts, reverse=True):
            if left <= r["n"]:
                if (lo, hi) == (r["lo"], r["hi"]):
                    return lo
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo if lo == hi else _rank_inside(df, lo, hi, left)


def _rank_inside(df: DataFrame, lo: float, hi: float, left: int) -> float:
    """The rest of kth_largest where neighbouring doubles cannot be cut by a width."""
    for r in df.where(F.col("x").between(lo, hi)).groupBy("x").count().orderBy(F.desc("x")).collect():
        if left <= r["count"]:
            return r["x"]
        left -= r["count"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, keep_good: float = 0.99, seed: int = 17, n_bins: int = 4000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_ngrams, log_weight, drawn (log weight and noise), kept.

    ``labels`` has doc_id, quality and toxic (1 or 0). ``share``: part of the documents
    with words that is drawn.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = ids_and_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    half = F.xxhash64("doc_id", F.lit(seed + 1)) % 2 == 0
    target = hash_sample(known.where(half).where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id"), TARGET_DOCS, seed)
    target = target.toPandas()["doc_id"].to_numpy(dtype=np.int64)
    counts = (texts.mapInArrow(_models(spark.sparkContext.broadcast(np.sort(target))), "bucket int, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas())
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    ratio = spark.sparkContext.broadcast(log_ratio(raw, good))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "n_ngrams", "log_weight", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    drawn = saved(texts.mapInArrow(_weigh(ratio), "doc_id long, n_ngrams long, log_weight double")
                  .withColumn("drawn", F.when(F.col("log_weight").isNotNull(), F.col("log_weight") - F.log(-F.log(uniform)))), "drawn")
    if share is not None:
        n = drawn.where("drawn is not null").count()
        least = kth_largest(drawn, "drawn", round(share * n))
    else:
        lo, hi = drawn.agg(F.min("drawn"), F.max("drawn")).first()
        least = float("-inf")
        if lo is not None and hi > lo:
            # bins count from the largest down, as pick_threshold rejects from a bin on
            at = F.least(F.lit(n_bins - 1), F.floor((F.lit(hi) - F.col("drawn")) / ((hi - lo) / n_bins))).cast("int")
            bins = (drawn.where("drawn is not null").select("doc_id", at.alias("bin")).join(known.where(~half).where("quality in (0, 1)"), "doc_id")
                    .groupBy("bin").agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad")).collect())
            cut = pick_threshold([tuple(r) for r in bins], n_bins, keep_good)
            if cut <= 1:
                k = drawn.where(F.col("drawn") > hi - cut * (hi - lo)).count()
                least = kth_largest(drawn, "drawn", k)
    return drawn.select("doc_id", "n_ngrams", "log_weight", "drawn", F.coalesce(F.col("drawn") >= F.lit(float(least)), F.lit(False)).alias("kept"))
