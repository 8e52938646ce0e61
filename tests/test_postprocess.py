import pytest
from pyspark.sql import functions as F

from corpuskit.functions.postprocess import post_process_summary, post_process_training

# Golden cases (FIXTURES.md part C), input -> expected output.
INFERENCE = [
    ("", ""),
    ("One short sentence.", "One short sentence."),
    ("A b c. D e f.", "1. A b c.\n2. D e f."),
    ("1. Alpha beta.<n>3. Gamma delta.", "1. Alpha beta.\n2. Gamma delta."),
    ("1. Alpha beta gamma.<n>2. Tail", "1. Alpha beta gamma."),
    ("1. Alpha<n><n>note without number.<n>7. Omega end.", "1. Alpha\nnote without number.\n2. Omega end."),
    ("1. The court held that the claim was barred by the statute, with",
     "1. The court held that the claim was barred by the statute, etc."),
    ("1. The court held that the claim was barred by statute and costs",
     "1. The court held that the claim was barred by statute."),
    ("1. The court held that the claim was barred", "1. The court held that the claim was barred..."),
    ("1. The court held that the claim was barred by law. See also",
     "1. The court held that the claim was barred by law."),
]


def _run(spark, fn, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = {r.id: r.o for r in df.select("id", fn(F.col("t")).alias("o")).collect()}
    return [got[i] for i in range(len(cases))]


def test_inference_goldens(spark):
    got = _run(spark, post_process_summary, INFERENCE)
    assert got == [e for _, e in INFERENCE]


def test_training_variant(spark):
    cases = [("A b c. D e f.", "A b c. D e f."), ("1. Alpha beta.\n3. Gamma delta.", "1. Alpha beta.\n2. Gamma delta."),
             ("", "")]
    assert _run(spark, post_process_training, cases) == [e for _, e in cases]
