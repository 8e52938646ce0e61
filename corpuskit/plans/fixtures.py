"""Fixture views over the driver tables (FIXTURES.md part B), in both dialects.

Each view is a Spark DataFrame builder plus the DuckDB CTE that defines the same
rows; the oracle SQL strings of the query catalog are built from these CTEs.
All views read the full tables — nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.common import md5_bucket
from corpuskit.functions.text import clean_text, split_sentences

# Split buckets (train < 80 <= validation < 90 <= test).
TRAIN_CUT = 80
VALIDATION_CUT = 90


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(id_col="doc_id") -> Column:
    b = md5_bucket(id_col)
    return (F.when(b < TRAIN_CUT, "train").when(b < VALIDATION_CUT, "validation")
            .otherwise("test"))


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def v_scotus(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    return (documents(spark, d).join(lab, "doc_id")
            .select("doc_id", "text", "label", split_of().alias("split")))


def v_ledgar(spark, d) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("label"))
    return (documents(spark, d).join(lab, "doc_id")
            .select("doc_id", "text", "label", split_of().alias("split")))


def v_unfair(spark, d) -> DataFrame:
    m = F.col("doc_id") % 5
    labels = (F.when(m == 0, F.array().cast("array<bigint>"))
              .when(m == 1, F.array(F.col("doc_id") % 8, F.lit(3).cast("bigint")))
              .when(m == 2, F.array(F.lit(9).cast("bigint")))
              .when(m == 3, F.array(F.lit(-1).cast("bigint"), F.lit(2).cast("bigint")))
              .otherwise(F.array(F.lit(7).cast("bigint"))))
    return documents(spark, d).select("doc_id", "text", labels.alias("labels"), split_of().alias("split"))


def v_casehold(spark, d) -> DataFrame:
    m = F.col("doc_id") % 6
    label = (F.when(m == 5, F.lit(None).cast("string")).when(m == 4, "x").when(m == 3, "7")
             .otherwise((F.col("doc_id") % 3).cast("string")))
    return documents(spark, d).select("doc_id", "text", label.alias("label"), split_of().alias("split"))


def v_pairs(spark, d) -> DataFrame:
    """User turn followed by an assistant turn: ``pred`` = user text, ``ref`` = the
    assistant answer.  Turns are dense per conversation, so "next turn" is an
    equi-join on ``turn + 1`` (no per-conversation window)."""
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("pred"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return u.join(a, ["conv_id", "turn"])


def v_turk(spark, d) -> DataFrame:
    """Multi-reference rows: ``original`` = first turn text, ``simplifications`` =
    assistant texts in turn order (possibly empty)."""
    c = table(spark, d, "conversations")
    return (c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("original"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant",
                                           F.struct("turn", "text")))).alias("_s"))
            .select("conv_id", "original", F.transform("_s", lambda s: s["text"]).alias("simplifications")))


def v_logits(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").cast("bigint").alias("label"))


def points_text(text_col="text", id_col="doc_id") -> Column:
    """v_points: every sentence of the document, prefixed ``k. `` for even ids,
    joined with ``<n>``; for ids divisible by 3 a final period is removed."""
    a = split_sentences(clean_text(text_col))
    numbered = F.when(F.col(id_col) % 2 == 0,
                      F.transform(a, lambda z, k: F.concat((k + 1).cast("string"), F.lit(". "), z))
                      ).otherwise(a)
    j = F.array_join(numbered, "<n>")
    return F.when((F.col(id_col) % 3 == 0) & j.endswith("."),
                  F.substring(j, F.lit(1), F.length(j) - 1)).otherwise(j)


def v_points(spark, d) -> DataFrame:
    return documents(spark, d).select("doc_id", points_text().alias("summary"))


# The label dimension used by the lookup queries.  ``ledgar`` has no
# map (NoMapForTask) and ``unfair_tos`` omits id 7 (NotInMap).
LABEL_NAMES = {
    "scotus": ["low_quality", "high_quality"],
    "unfair_tos": ["Limitation of liability", "Unilateral termination", "Unilateral change",
                   "Content removal", "Contract by using", "Choice of law", "Jurisdiction"],
    "casehold": ["0", "1", "2", "3", "4"],
}

# A small legal-term -> plain-word dictionary for the simplifier.
PLAIN_TERMS = [
    ("the", "that"), ("and", "plus"), ("in", "inside"), ("of", "from"), ("is", "be"),
    ("der", "the"), ("die", "the"), ("la", "the"), ("le", "the"), ("de", "of"),
]


def label_names_df(spark) -> DataFrame:
    rows = [(t, names) for t, names in LABEL_NAMES.items()]
    return spark.createDataFrame(rows, "task string, names array<string>")


# ---------------------------------------------------------------------------
# DuckDB side: the same views as CTE text.

DUCK_SPLIT = ("CASE WHEN ('0x'||substr(md5({c}::VARCHAR),1,8))::BIGINT % 100 < 80 THEN 'train' "
              "WHEN ('0x'||substr(md5({c}::VARCHAR),1,8))::BIGINT % 100 < 90 THEN 'validation' "
              "ELSE 'test' END")


def duck_split(c="doc_id") -> str:
    return DUCK_SPLIT.format(c=c)


def duck_bucket(c: str, seed: str | None = None, modulo: int = 100) -> str:
    key = f"{c}::VARCHAR" if seed is None else f"({c}::VARCHAR || '{seed}')"
    return f"(('0x'||substr(md5({key}),1,8))::BIGINT % {modulo})"


DUCK_VIEWS = {
    "v_scotus": f"SELECT d.doc_id, d.text, l.quality::BIGINT AS label, {duck_split('d.doc_id')} AS split "
                "FROM documents d JOIN labels l USING (doc_id)",
    "v_ledgar": f"SELECT d.doc_id, d.text, l.toxic::BIGINT AS label, {duck_split('d.doc_id')} AS split "
                "FROM documents d JOIN labels l USING (doc_id)",
    "v_unfair": "SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN []::BIGINT[] "
                "WHEN 1 THEN [doc_id % 8, 3]::BIGINT[] WHEN 2 THEN [9]::BIGINT[] "
                "WHEN 3 THEN [-1, 2]::BIGINT[] ELSE [7]::BIGINT[] END AS labels, "
                f"{duck_split()} AS split FROM documents",
    "v_casehold": "SELECT doc_id, text, CASE doc_id % 6 WHEN 5 THEN NULL WHEN 4 THEN 'x' WHEN 3 THEN '7' "
                  f"ELSE (doc_id % 3)::VARCHAR END AS label, {duck_split()} AS split FROM documents",
    "v_pairs": "SELECT u.conv_id, u.turn, u.text AS pred, a.text AS ref FROM conversations u "
               "JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
               "WHERE u.role = 'user' AND a.role = 'assistant'",
    "v_turk": "SELECT conv_id, arg_min(text, turn) AS original, "
              "coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []::VARCHAR[]) "
              "AS simplifications FROM conversations GROUP BY conv_id",
    "v_logits": "SELECT vec_id, embedding::DOUBLE[] AS logits, label::BIGINT AS label FROM embeddings",
}


def duck_label_dim_values() -> str:
    rows = []
    for t, names in LABEL_NAMES.items():
        for i, n in enumerate(names):
            rows.append("('%s', %d, '%s')" % (t, i, n.replace("'", "''")))
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(task, label_id, label_name)"


def duck_terms_values() -> str:
    rows = ", ".join("('%s', '%s')" % (a, b) for a, b in PLAIN_TERMS)
    return "SELECT * FROM (VALUES " + rows + ") AS t(term, plain)"


def duck_with(*names: str, extra: dict | None = None) -> str:
    """WITH clause defining the named views (in order), plus extra CTEs."""
    parts = [f"{n} AS ({DUCK_VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
