"""The corpus pipeline: documents in, packed training windows out.

Stages in order, each on all rows that the one before kept:

1. quality rules: documents that the base rule or the isolation forest rejects go;
2. n-gram Jaccard join: of each group of near copies the smallest id stays;
3. PII: accepted spans of personal data are replaced in the text, ``n_chars`` follows;
4. mixing: rows are sorted by their slot in the mix of sources, over the whole table;
5. packing: the texts' ids in windows of 2048, numbered in the order of the mix: a window
   holds neighbours in it, and windows up to any number follow the target weights.

Null texts have no words and go in stage 1; so do texts under ten words. Rows with one
id are one document in stage 2; rows without an id stay there. Of equal near copies the
smallest id stays; rows of one slot are ordered by their hash. Very long texts are whole
in every stage and cut into windows in the last. Extra columns of the
input are kept up to stage 4. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import saved, table
from llm.mixing import mixed
from llm.ngram_jaccard import one_of_each
from llm.packing import file_runs, pack
from llm.pii import redact
from llm.quality_rules import good_documents

#: Learned and tokenizing stages have no SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in clean.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), run=file_runs(docs))


STAGES = [("quality rules", quality), ("near copies", near_copies), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
