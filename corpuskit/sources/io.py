"""Sources and sinks.

Split datasets live as one parquet table partitioned by ``split`` (partition
pruning replaces per-split folders); every read is lazy and every write is one
distributed job.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# Preferred split order for the "first available split" fallback.
SPLIT_ORDER = ["train", "validation", "test"]
# Column-name hints used to guess text / summary columns.
TEXT_HINTS_EXTRACTIVE = ["text", "content", "opinion"]
TEXT_HINTS_ABSTRACTIVE = ["text", "content", "document", "opinion"]
SUMMARY_HINTS = ["summary", "abstract", "syllabus"]


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A saved multi-split dataset; ``split`` comes from the partition folder."""
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "ignore", split_col: str = "split") -> None:
    """One write partitioned by split; ``mode="ignore"`` skips an existing
    *finished* target (idempotent re-run); a half-written one, without the success
    marker, is written again."""
    if mode == "ignore":
        if finished(df.sparkSession, path):
            return
        mode = "overwrite"
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table's last write was committed."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its Hadoop file system (any scheme)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session (any scheme)."""
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def resolve_source(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: the first existing of processed -> standardized -> fallback paths."""
    for p in paths:
        if finished(spark, p):
            return read_splits(spark, p)
    raise FileNotFoundError(f"none of the candidate paths holds a finished table: {paths}")


def read_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """The requested split, else the first available one (train, validation,
    test, then by name).  One aggregate over the split column decides."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.col(split_col)), F.lit(0)), F.lit(len(SPLIT_ORDER) + 1))
    found = df.agg(F.bool_or(F.col(split_col) == split).alias("there"),
                   F.min(F.when(F.col(split_col).isNotNull(), F.struct(rank.alias("r"), F.col(split_col).alias("s")))).alias("first")).first()
    if found["there"] or found["first"] is None:
        return df.where(F.col(split_col) == split)
    log.warning("split %r not found, using %r", split, found["first"]["s"])
    return df.where(F.col(split_col) == found["first"]["s"])


def read_pairs_csv(spark: SparkSession, path: str, first: str = "complex", second: str = "simple", multi_line: bool = True) -> DataFrame:
    """CSV with ``complex,simple``; other names -> columns 1 and 2 renamed;
    fewer than 2 columns -> error; a one-column parse retries as TSV.  With
    ``multi_line=False`` (no line breaks inside fields) large files are split into tasks."""
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if len(df.columns) < 2:
        df = spark.read.option("header", True).option("sep", "\t").option("multiLine", multi_line).option("escape", '"').csv(path)
    if len(df.columns) < 2:
        raise ValueError(f"{path}: expected at least two columns, found {df.columns}")
    if not {first, second} <= set(df.columns):
        c = df.columns
        df = df.withColumnsRenamed({c[0]: first, c[1]: second})
    return df.select(first, second)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, UTF-8: ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


def literal_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Texts passed as arguments (demo input), with ids."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def export_path(dataset: str, split: str) -> str:
    """Where an export goes when no path is given."""
    return f"data/exports/{dataset}_{split}.csv"  # fixed value: the default folder


def export_csv(df: DataFrame, path: str, id_col: str, split: str | None = None, n: int | None = None,
               split_col: str = "split") -> None:
    """Optional split filter and first-n by id; CSV with header, no index."""
    if split is not None and split_col in df.columns:
        df = df.where(F.col(split_col) == split)
    if n is not None:
        df = df.orderBy(id_col).limit(n)
    # RFC 4180 quoting (doubled quotes), as pandas writes it; texts keep newlines
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_report(df: DataFrame, path: str, report_col: str = "report") -> None:
    """The text report column written as text files."""
    df.select(report_col).write.mode("overwrite").text(path)


LABEL_COUNT_SCHEMA = T.StructType([T.StructField("task", T.StringType()),
                                   T.StructField("num_labels", T.LongType())])


def write_label_counts(df: DataFrame, path: str) -> None:
    """S10 sink: ``{task, num_labels}`` JSON lines."""
    df.select(F.col("task").cast("string"), F.col("num_labels").cast("bigint")).write.mode("overwrite").json(path)


def read_label_counts(spark: SparkSession, path: str) -> DataFrame:
    """S10 source, with the declared schema (str / int coercion)."""
    return spark.read.schema(LABEL_COUNT_SCHEMA).json(path)


def run_isolated(jobs: dict, spark: SparkSession) -> DataFrame:
    """Run per-dataset jobs; one failure is recorded, the loop continues.
    Returns a status table ``(dataset, status, error)``."""
    rows = []
    for name, job in jobs.items():
        try:
            job()
            rows.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 — reported as a row, not raised
            log.error("dataset %s failed: %s", name, e)
            rows.append((name, "failed", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "dataset string, status string, error string")


def pick_column(df: DataFrame, wanted: str | None, hints: list[str], lower: bool = True) -> str:
    """The wanted column if present, else the first whose name contains a hint."""
    if wanted and wanted in df.columns:
        return wanted
    for c in df.columns:
        name = c.lower() if lower else c
        if any(h in name for h in hints):
            return c
    raise ValueError(f"no column matches {wanted!r} or hints {hints}; columns: {df.columns}")


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Error when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
