"""Shared pieces of the operators: input tables, written intermediates, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Put the two packages on the Python workers' path, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="llm-pkg-"), "llm_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for pkg in ("llm", "corpuskit"):
            for root, _, files in os.walk(os.path.join(top, pkg)):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, top))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch folder only where it is unset
    and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return ensure_checkpoint_dir(spark).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends
    here, the work is not repeated, and a lost executor loses nothing."""
    return read_saved(df.sparkSession, write_saved(df, name), df.schema)


def write_saved(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    # all of an application's intermediates are below one folder, to be removed with it
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_saved(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, so that other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hash_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` distinct rows, those with the smallest hash (fewer only where the table is
    small or by the chance of the hash): rows are thinned by the hash first, so that no
    task sends more than its share to the driver."""
    h = F.xxhash64(*df.columns, F.lit(seed))
    total = df.count()
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(h, 1) < int((1 << 63) * (2 * n / total)))
    return df.distinct().orderBy(h, *df.columns).limit(n)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, root the smallest
    node of the component, for every node of ``edges`` (null ends and loops are ignored).

    Alternating large-star and small-star rounds (each one grouped minimum and one
    join on the node), written to the shared folder after each round and stopped when
    the edge set no longer changes. A node with very many neighbours only meets its
    minimum: the grouped minimum combines on the map side and the join is one that
    Spark can split.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path = write_saved(e, "edges")
    schema = e.schema
    last = None
    for _ in range(max_rounds):
        e = read_saved(spark, path, schema)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours larger than u go to the smallest of u's neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
             .union(low.select("u", F.col("m").alias("v"))).distinct())
        new = write_saved(e, "edges")
        forget(spark, path)
        path = new
        h = F.xxhash64("u", "v")
        state = read_saved(spark, path, schema).agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    e = read_saved(spark, path, schema)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
