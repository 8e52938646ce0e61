"""Frequency vocabulary and encoding by it (X9): dense ids by corpus frequency.

A vocabulary is a table ``(token, n, token_id)``: one grouped count over the corpus, then ids in the order
of (frequency descending, token) from range partitions, whose rows number themselves and whose
sizes give the offsets, so no window spans the vocabulary and ties of one frequency may fill many
partitions.  Encoding looks tokens up in the task (a hash lookup over Arrow arrays) and makes ids,
padding and mask from one tokenisation of the row.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuskit.functions.text import lower_tokens
from corpuskit.session import scratch_dir, ship_package

# Reserved ids and the usual size of a sub-word vocabulary.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2
DEFAULT_SIZE = 30_000
LOOKUP_BYTES = 256 << 20  # largest token table that is sent to the tasks
_LOCAL = (1 << 33) - 1


def ranked(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """``df`` with its position in ``order`` (a total order, or ties in any order), from ``start``.

    Sorted range partitions are written with each row's own number; the partitions' sizes (one row
    a partition) give the offsets."""
    path = scratch_dir(df.sparkSession, "ranked") + "/table"
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_m", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_m").bitwiseAND(F.lit(_LOCAL)) + start)
            .drop("_m", "_part", "_before"))


def build_vocabulary(df: DataFrame, text: str = "text", size: int | None = DEFAULT_SIZE, min_count: int = 1) -> DataFrame:
    """``(token, n, token_id)``; ids from ``FIRST_ID`` by falling frequency, ties by token.  ``size`` counts the
    reserved ids; ``None`` keeps every token with at least ``min_count`` occurrences."""
    counts = df.select(F.explode(lower_tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    v = ranked(counts, [F.desc("n"), F.asc("token")], "token_id", FIRST_ID)
    return v if size is None else v.where(F.col("token_id") < size)


def _lookup(vocabulary: DataFrame):
    """The tokens and their ids as Arrow arrays for the tasks; a table beyond the bound is an error, as a
    vocabulary's size is a parameter of its model."""
    size = vocabulary.agg(F.sum(F.octet_length("token") + 12)).first()[0] or 0
    if size > LOOKUP_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is beyond {LOOKUP_BYTES}; build it with a smaller size")
    t = vocabulary.select("token", F.col("token_id").cast("int").alias("token_id")).toArrow()
    return vocabulary.sparkSession.sparkContext.broadcast((t["token"].combine_chunks(), t["token_id"].combine_chunks()))


def token_ids(tokens: Column, lookup) -> Column:
    """Ids of an array of tokens, ``UNKNOWN_ID`` for those outside the vocabulary."""
    def run(batch: pa.Array) -> pa.Array:
        known, ids = lookup.value
        at = pc.index_in(batch.flatten(), value_set=known) if len(known) else pa.nulls(len(batch.flatten()), pa.int32())
        found = pc.fill_null(ids.take(at), UNKNOWN_ID)
        sizes = pc.fill_null(pc.list_value_length(batch), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, found.cast(pa.int32()))
    return F.arrow_udf(run, "array<int>")(tokens)


def encode_with_vocabulary(df: DataFrame, vocabulary: DataFrame, text: str = "text", length: int = 512) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of constant ``length``; null texts are all padding."""
    ship_package(df.sparkSession)
    lookup = _lookup(vocabulary)
    toks = F.coalesce(F.slice(lower_tokens(text), 1, length), F.array().cast("array<string>"))
    ids = df.withColumn("_ids", token_ids(toks, lookup))
    room = F.lit(length) - F.size("_ids")
    return ids.select(*df.columns, F.concat("_ids", F.array_repeat(F.lit(PAD_ID), room)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), room)).alias("attention_mask"))
