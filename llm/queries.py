"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import licenses, mixing, prefix_trie, vector_codes
from llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, similarity 0.8 or more."""
    from llm.ngram_jaccard import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids of the byte-level 50k vocabulary."""
    import public_tokenizers
    from llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the forest's verdict for all documents, calibrated on all labelled rows."""
    from llm.quality_rules import COUNTS, quality_rules
    return (quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .select("doc_id", *COUNTS, "base_failed", "kept", "score"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    from pyspark.sql import functions as F

    from llm.pii import BASE, find, joined
    df = find(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                     F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))


@query(licenses.oracle_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query(mixing.oracle_sql())
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mix of all sources, weighted by the root of their size."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match token counts of all documents by the byte-level 50k vocabulary."""
    import public_tokenizers

    from llm.wordpiece import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn towards the text labelled good."""
    from llm.importance import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from llm.main_text import main_text
    return main_text(table(spark, sf_dir, "pages"))


@query()
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all vectors."""
    from llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


@query(vector_codes.oracle_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 8 codebooks of 16 entries, 6 rounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most 3 bits."""
    from llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query(prefix_trie.oracle_sql())
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations, with its subtree's totals."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
