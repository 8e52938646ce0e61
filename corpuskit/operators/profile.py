"""Dataset profiling.

Exact quantiles are computed by rank selection: values are ranked with the
bucketed global rank (no single-task sort), then only the rows at the needed
ranks are picked — never by collecting a column into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.splits import _local_index
from corpuskit.session import scratch_dir

# Distinct values are listed only below this count.
LIST_VALUES_BELOW = 20
QUANTILES = (0.25, 0.5, 0.75)


def rows_per_split(df: DataFrame, split_col: str = "split") -> DataFrame:
    """A2: rows per split plus the total row, told apart from a null split by ``is_total``."""
    return df.rollup(split_col).agg(F.count("*").alias("n_rows"), (F.grouping_id() > 0).alias("is_total"))


def sample_label_range(df: DataFrame, id_col: str, label: str, group: str, n: int = 1000) -> DataFrame:
    """A4: min / max label over the first ``n`` rows (by id) of each group."""
    from corpuskit.operators.splits import first_per_group
    return first_per_group(df, n, id_col, group).groupBy(group).agg(
        F.min(label).alias("sample_min"), F.max(label).alias("sample_max"), F.count("*").alias("sample_rows"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values (containers compared by their string form)
    and the sorted values when there are fewer than 20.  Null counts as a value and is
    listed last, as ``None``.  Only the first 20
    sorted values are ever gathered (top-n), never the whole distinct set."""
    s = df.select(F.col(column).cast("string").alias("v")).distinct()
    n = s.agg(F.count("*").alias("n_distinct")).withColumn("column", F.lit(column))
    few = (s.orderBy(F.col("v").asc_nulls_last()).limit(LIST_VALUES_BELOW)
           .agg(F.array_join(F.concat(F.sort_array(F.collect_list("v")), F.when(F.count_if(F.col("v").isNull()) > 0, F.array(F.lit("None")))
                                      .otherwise(F.array().cast("array<string>"))), "|").alias("_vals"))
           .withColumn("column", F.lit(column)))
    return (n.join(few, "column", "left")
            .select("column", "n_distinct",
                    F.when(F.col("n_distinct") < LIST_VALUES_BELOW, F.col("_vals")).alias("values")))


def exact_quantiles(df: DataFrame, column: str, probs=QUANTILES) -> DataFrame:
    """Linear-interpolated exact quantiles (pandas / numpy ``linear``).

    Rank selection on the value histogram: counts per distinct value (map-side
    combined, so a value held by a third of the rows is one row), exclusive
    prefix sums by the bucketed rank, then the few wanted ranks are matched to
    the value whose rank range covers them."""
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    hist = v.groupBy("v").agg(F.count("*").alias("c"))
    cum = _local_index(hist, "v", None, out="start", weight="c")
    n = hist.agg(F.sum("c").alias("n"))
    want = (n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), ((F.col("n") - 1) * p).alias("h"))
                                         for p in probs])).alias("q"))
            .select("q.p", "q.h", F.floor("q.h").cast("bigint").alias("lo"), F.ceil("q.h").cast("bigint").alias("hi")))
    ranks = want.select(F.explode(F.array("lo", "hi")).alias("k")).distinct()
    # at most 2 * len(probs) wanted ranks: a proven bound
    hit = (cum.join(F.broadcast(ranks), (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("c")))
           .select("k", "v"))
    both = (want.join(hit.select(F.col("k").alias("lo"), F.col("v").alias("vlo")), "lo")
            .join(hit.select(F.col("k").alias("hi"), F.col("v").alias("vhi")), "hi"))
    return both.select("p", (F.col("vlo") + (F.col("h") - F.col("lo")) * (F.col("vhi") - F.col("vlo"))).alias("q"))


HEAD = 64  # characters by which the most frequent strings are told apart before whole values are read


def describe_columns(df: DataFrame, columns: list[str] | None = None, first: int | None = None, order: str | None = None) -> DataFrame:
    """``describe(include="all")`` as a long table ``(column, stat, value_num, value_str)``:
    count, unique/top/freq for strings; mean, std, min, quartiles, max for numbers.  ``first``: of the
    first rows by ``order`` only.

    Three scans, whatever the number of columns: one aggregate; one histogram of all columns' values
    (strings by digest and their first characters), written, from which a single prefix sum over (column,
    value) gives every quantile; and one look for the most frequent strings."""
    columns = columns or df.columns
    if first is not None:
        df = df.orderBy(order or columns[0]).limit(first)
    spark = df.sparkSession
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    strings = [c for c in columns if c not in numeric]
    text = lambda c: F.col(c).cast("string")
    row = lambda c, stat, value: F.struct(F.lit(c).alias("column"), F.lit(stat).alias("stat"), value.cast("double").alias("value"))
    stats = [row(c, "count", F.count(c)) for c in columns]
    for c in numeric:
        stats += [row(c, "mean", F.avg(c)), row(c, "std", F.stddev_samp(c)), row(c, "min", F.min(c)), row(c, "max", F.max(c))]
    base = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))

    none = lambda kind: F.lit(None).cast(kind)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("num"), none("string").alias("digest"), none("string").alias("head")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column"), none("double").alias("num"), F.sha2(text(c), 256).alias("digest"), F.substring(text(c), 1, HEAD).alias("head")) for c in strings]
    path = scratch_dir(spark, "histogram") + "/table"
    (df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("num is not null or digest is not null")
     .groupBy("column", "num", "digest").agg(F.count("*").alias("c"), F.first("head").alias("head")).write.parquet(path))
    hist = spark.read.parquet(path)
    parts = [base]
    if numeric:
        own = hist.where("num is not null").select("column", "num", "c")
        h = (F.col("n") - 1) * F.col("p")
        want = (own.groupBy("column").agg(F.sum("c").alias("n")).withColumn("p", F.explode(F.array(*[F.lit(p) for p in QUANTILES])))
                .select(F.col("column").alias("_c"), "p", (h - F.floor(h)).alias("part"), F.floor(h).cast("long").alias("lo"), F.ceil(h).cast("long").alias("hi")))
        inside = lambda k: (F.col(k) >= F.col("start")) & (F.col(k) < F.col("start") + F.col("c"))
        # a row for each column and quantile: a proven bound
        hit = _local_index(own, "num", "column", out="start", weight="c").join(F.broadcast(want), (F.col("column") == F.col("_c")) & (inside("lo") | inside("hi")))
        q = hit.groupBy("column", "p", "part").agg(F.max(F.when(inside("lo"), F.col("num"))).alias("a"), F.max(F.when(inside("hi"), F.col("num"))).alias("b"))
        parts.append(q.select("column", F.concat((F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value")))
    if strings:
        own = hist.where("digest is not null")
        most = own.groupBy("column").agg(F.count("*").alias("unique"), F.max("c").alias("freq"))
        parts.append(most.select(F.inline(F.array(*[F.struct("column", F.lit(k).alias("stat"), F.col(k).cast("double").alias("value")) for k in ("unique", "freq")]))))
        often = own.join(F.broadcast(most.select("column", F.col("freq").alias("c"))), ["column", "c"])  # a row for each column
        head = often.groupBy("column").agg(F.min("head").alias("head"))
        often = often.join(F.broadcast(head), ["column", "head"]).select("column", "head", "digest")
        values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in strings])).alias("x")).select("x.*").where("v is not null")
        values = (values.withColumn("head", F.substring("v", 1, HEAD)).join(F.broadcast(head), ["column", "head"])
                  .withColumn("digest", F.sha2("v", 256)).join(often.select("column", "digest"), ["column", "digest"], "left_semi"))
        top = values.groupBy("column").agg(F.min("v").alias("value_str")).select("column", F.lit("top").alias("stat"), none("double").alias("value_num"), "value_str")
        there = spark.createDataFrame([(c,) for c in strings], "column string")
        gaps = there.select(F.inline(F.array(*[F.struct("column", F.lit(k).alias("stat"), F.lit(v).cast("double").alias("value")) for k, v in (("unique", 0.0), ("freq", None))])))
        found = parts.pop()
        parts.append(found.unionByName(gaps.join(found.select("column").distinct(), "column", "left_anti")))
        top = there.join(top.drop("stat"), "column", "left").select("column", F.lit("top").alias("stat"), "value_num", "value_str")
    out = reduce(lambda a, b: a.unionByName(b), parts).select("column", "stat", F.round("value", 6).alias("value_num"), none("string").alias("value_str"))
    return out.unionByName(top) if strings else out


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """Type, rows, nulls, distinct count and listed values of one column."""
    dv = distinct_values(df, column)
    base = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null"))
    return (base.withColumn("column", F.lit(column)).join(dv, "column")
            .select("column", F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
                    "n_rows", "n_null", "n_distinct", "values"))
