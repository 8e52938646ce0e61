"""Classifier training re-aimed on Spark ML.

The reference fine-tunes a shared transformer encoder with one linear head per
task.  Here the shared encoder is a hashed TF-IDF representation fitted once on
the union of all tasks, and each task gets its own logistic-regression head —
every fit is a distributed Spark ML job; only the (few) tasks are looped over.
The evaluations use ``joint.py``, which fits all heads in one run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators.joint import predict_joint, train_joint
from corpuskit.operators.metrics import classification_metrics

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _encoder(text: str, num_features: int) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
    ])


@dataclass
class MultitaskModel:
    """A shared encoder and one head per task."""
    encoder: PipelineModel
    heads: dict[str, LogisticRegressionModel] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Write the encoder, every head and the table of tasks below ``path``."""
        spark = SparkSession.getActiveSession()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        rows = [(t, f"head-{i}") for i, t in enumerate(sorted(self.heads))]
        for t, name in rows:
            self.heads[t].write().overwrite().save(f"{path}/{name}")
        spark.createDataFrame(rows, "task string, head string").coalesce(1).write.mode("overwrite").json(f"{path}/tasks")

    @classmethod
    def load(cls, path: str) -> "MultitaskModel":
        spark = SparkSession.getActiveSession()
        rows = spark.read.schema("task string, head string").json(f"{path}/tasks").collect()
        return cls(PipelineModel.load(f"{path}/encoder"), {r.task: LogisticRegressionModel.load(f"{path}/{r['head']}") for r in rows})


def train_multitask(df: DataFrame, num_features: int = 4096, text: str = "input_text", label: str = "input_label",
                    task: str = "task_name", max_iter: int = 50, reg: float = 0.01, min_classes: int = 2) -> MultitaskModel:
    """Shared encoder fitted on all tasks' training rows, one LR head per task (every
    task gets one; labels below ``min_classes`` always exist as classes, as in the
    two-class default of C7).  The tasks are looped over: one distributed fit each."""
    df = df.where(F.col(label).isNotNull() & F.col(task).isNotNull() & (F.col(label) >= 0))
    enc = _encoder(text, num_features).fit(df)
    # the features feed one fit per task: keep them (memory, spilling to disk)
    # instead of re-tokenising the corpus for every head
    feats = enc.transform(df).select(task, F.col(label).cast("double").alias("label"), "features") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        heads = {}
        for t in sorted(r[0] for r in feats.select(task).distinct().collect()):
            own = feats.where(F.col(task) == t)
            lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg)
            if own.agg(F.max("label")).first()[0] < min_classes - 1:
                lr = lr.setFamily("multinomial")
            heads[t] = lr.fit(own)
    finally:
        feats.unpersist()
    return MultitaskModel(enc, heads)


def predict_multitask(model: MultitaskModel, df: DataFrame, task: str = "task_name") -> DataFrame:
    """Predict each row with its own task's head; the text is encoded once and the head is
    looked up per row.  Rows of a task without a head keep a null ``pred``."""
    heads = {t: (np.asarray(m.coefficientMatrix.toArray()), np.asarray(m.interceptVector.toArray()), m.numClasses) for t, m in model.heads.items()}
    shared = df.sparkSession.sparkContext.broadcast(heads)

    def run(tasks: pd.Series, index: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for t, i, v in zip(tasks, index, value):
            head = shared.value.get(t)
            if head is None:
                out.append(None)
                continue
            w, b, n = head
            margin = w[:, np.asarray(i, dtype=np.int64)] @ np.asarray(v, dtype=float) + b if len(i) else b
            out.append(int(margin[0] > 0) if len(margin) == 1 and n == 2 else int(np.argmax(margin)))
        return pd.Series(out, dtype="Int64")

    feats = model.encoder.transform(df).withColumn("_v", F.unwrap_udt("features"))
    # a sparse vector holds its indices; a dense one (all features) is numbered
    index = F.coalesce("_v.indices", F.sequence(F.lit(0), F.size("_v.values") - 1))
    pred = F.pandas_udf(run, "bigint")(F.col(task), index, F.col("_v.values"))
    return feats.withColumn("pred", pred).drop("_tok", "_tf", "features", "_v")


def evaluate_multitask(df: DataFrame, num_features: int = 4096, split_col: str = "split",
                       task: str = "task_name", label: str = "input_label") -> DataFrame:
    """C6 + C8: fit all heads together on ``train``, report accuracy / weighted F1 per task on ``test``;
    rows of a task without a head count as wrong."""
    model = train_joint(df.where(F.col(split_col) == "train"), num_features, task=task, label=label)
    return _scored(predict_joint(model, df.where(F.col(split_col) == "test"), task), task, label)


def evaluate_single(df: DataFrame, num_features: int = 4096, split_col: str = "split",
                    label: str = "input_label") -> DataFrame:
    """One task of two classes or more; evaluated on ``validation`` when present, else
    on ``test``; without either all figures are 0."""
    there = df.agg(F.bool_or(F.col(split_col) == "validation")).first()[0]
    ev = "validation" if there else "test"
    d = df.withColumn("_task", F.lit("single"))
    model = train_joint(d.where(F.col(split_col) == "train"), num_features, task="_task", label=label)
    return _scored(predict_joint(model, d.where(F.col(split_col) == ev), "_task"), None, label).withColumn("eval_split", F.lit(ev))


def _scored(pred: DataFrame, task: str | None, label: str) -> DataFrame:
    """Figures in which a row without a prediction counts as wrong."""
    return classification_metrics(pred.withColumn("pred", F.coalesce("pred", F.lit(-1))), task, label, "pred")
