"""Structured Streaming entry points.

The checkpoint folder makes every stream restartable (exactly-once file sink), and ``availableNow``
processes what has arrived and stops.  ``stream_documents`` keeps no state;
``standardize_with_state`` keeps the documents that wait for a label in the stream's own state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.operators import labels as L
from corpuskit.sources import io

# waiting texts on disk, and no store kept open after its commit: an open one holds some megabytes of disk
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def document_stream(spark: SparkSession, source_dir: str, schema, glob: str = "documents.parquet") -> DataFrame:
    """A file stream of documents: the files of ``source_dir`` with that name or pattern, or, where the name is a
    table folder as Spark writes it, the part files in it."""
    table = f"{source_dir.rstrip('/')}/{glob}"
    if not set(glob) & set("*?[{") and io.is_folder(spark, table):
        return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(table)
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)


def stream_documents(spark: SparkSession, source_dir: str, schema, pipeline, sink_dir: str, checkpoint: str,
                     glob: str = "documents.parquet"):
    """Apply a stateless document chain (``pipeline(df) -> df``) to arriving
    documents and append the records to a parquet sink.  Returns the finished
    query (``availableNow``)."""
    out = pipeline(document_stream(spark, source_dir, schema, glob))
    q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def incremental_standardize(spark: SparkSession, source_dir: str, schema, labels: DataFrame, target: str,
                            checkpoint: str, split: Column, task: str = "scotus", label_col: str = "quality",
                            glob: str = "documents.parquet"):
    """Standardize only new files — stream-static join to the label table,
    P1 projection, and an exactly-once file-sink append partitioned by ``split`` (an
    expression over ``doc_id``).

    A document that arrives before its label waits in ``<target>-waiting`` (a second
    exactly-once sink); every run looks its label up again and appends what it finds to
    ``<target>-late``.  ``standardized_rows`` reads both parts.  The waiting sink commits first, so a run
    that is stopped between the two loses nothing, and a document that has gone the late way by
    the time its files reach the target's stream is left out there."""
    lab = labels.select("doc_id", F.col(label_col).cast("bigint").alias("label"))

    def append(rows: DataFrame, path: str, log: str, *parts: str):
        # the file sink keeps a commit log under the checkpoint: a restarted batch
        # never appends twice (exactly-once), unlike a plain append in foreachBatch
        w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", log)
        q = (w.partitionBy(*parts) if parts else w).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def docs() -> DataFrame:
        return document_stream(spark, source_dir, schema, glob).select("doc_id", "text")

    def standard(rows: DataFrame) -> DataFrame:
        return L.standardize_single_label(rows.withColumn("split", split), task)

    root = target.rstrip("/")
    waiting, late = f"{root}-waiting", f"{root}-late"
    went_late = _late_rows(spark, late)
    if io.path_exists(spark, waiting):
        # rows that waited in earlier runs; what an interrupted run appended is not appended again
        found = spark.read.schema("doc_id long, text string").parquet(waiting).join(lab, "doc_id")
        if went_late is not None:
            found = found.join(went_late.select("doc_id"), "doc_id", "left_anti")
        standard(found).write.mode("append").partitionBy("split").parquet(late)
        went_late = _late_rows(spark, late)
    append(docs().join(lab.select("doc_id"), "doc_id", "left_anti"), waiting, f"{checkpoint.rstrip('/')}-waiting")
    new = docs().join(lab, "doc_id")
    if went_late is not None:
        new = new.join(went_late.select("doc_id"), "doc_id", "left_anti")
    return append(standard(new), target, checkpoint, "split")


LATE = "doc_id long, input_text string, input_label long, task_name string, split string"


def _late_rows(spark: SparkSession, late: str) -> DataFrame | None:
    """What was appended late; read by its schema, as an append without rows leaves no file to infer one from."""
    return spark.read.schema(LATE).parquet(late) if io.path_exists(spark, late) else None


def standardized_rows(spark: SparkSession, target: str) -> DataFrame:
    """All rows that ``incremental_standardize`` has written for a target."""
    rows = spark.read.parquet(target)
    late = _late_rows(spark, f"{target.rstrip('/')}-late")
    return rows if late is None else rows.unionByName(late.select(*rows.columns))


MATCHED = "doc_id long, text string, label long"
STATE = "label long, texts array<string>"


def _match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one document and of its label: what waits leaves with the label, the rest stays in the state."""
    label, texts = state.get if state.exists else (None, [])
    texts = list(texts or [])
    for rows in batches:
        # plain lists: most keys have two rows, for which pandas selections cost most of the time
        marks = rows["is_label"].tolist()
        if label is None:
            known = [int(v) for v, mark in zip(rows["label"].tolist(), marks) if mark and not pd.isna(v)]
            label = min(known, default=None)
        texts += [t for t, mark in zip(rows["text"].tolist(), marks) if not mark]
    if label is not None and texts:
        yield pd.DataFrame({"doc_id": key[0], "text": texts, "label": label})
        texts = []
    state.update((label, texts))


def standardize_with_state(docs: DataFrame, labels: DataFrame, target: str, checkpoint: str, split: Column, task: str = "scotus",
                           label_col: str = "quality"):
    """T2 with state: a stream of documents meets a stream of labels in one stateful query with one
    exactly-once sink, partitioned by ``split``.

    Whichever comes first waits in the state of its doc_id (RocksDB, so waiting texts need not fit in memory) and
    leaves it when the other comes, in this run or a later one with the same checkpoint: nothing that
    waits is read again, and a stopped run goes on from its last commit.  Documents leave the state once
    they are written, a label stays for rows of the same id that come later.  Of several labels
    that arrive together the smallest counts; later ones change nothing.  Rows without an id, and labels without
    a value, are left out; documents that never get a label stay in the state."""
    spark = docs.sparkSession
    from corpuskit.session import ship_package
    ship_package(spark)
    none = lambda kind: F.lit(None).cast(kind)
    both = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none("long").alias("label"), F.lit(False).alias("is_label"))
            .unionByName(labels.select(F.col("doc_id").cast("long").alias("doc_id"), none("string").alias("text"), F.col(label_col).cast("long").alias("label"),
                                       F.lit(True).alias("is_label"))))
    rows = both.where("doc_id is not null and not (is_label and label is null)").groupBy("doc_id").applyInPandasWithState(
        _match, MATCHED, STATE, "append", GroupStateTimeout.NoTimeout)
    out = L.standardize_single_label(rows.withColumn("split", split), task)
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        q = (out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("split")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return q
