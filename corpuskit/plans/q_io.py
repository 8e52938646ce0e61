"""Catalog entries for loaders, round trips through files, column picking and stemmed ROUGE."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import metrics as M
from corpuskit.operators import pairs as P
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register
from corpuskit.plans.q_splits import _THREE
from corpuskit.session import scratch_dir
from corpuskit.sources import io

IDS = ["conv_id", "turn"]


@register("load_wikilarge", fx.duck_with("v_pairs") +
          f", s AS (SELECT *, {fx.duck_split('conv_id')} AS split FROM v_pairs) "
          "SELECT conv_id, turn, pred AS complex, ref AS simple, CASE WHEN (SELECT count(DISTINCT split) FROM s) = 3 THEN split "
          f"ELSE {_THREE.format(c='conv_id')} END AS split FROM s")
def q_load_wikilarge(spark, d):
    """C11: splits that are all there are kept."""
    wl = fx.v_pairs(spark, d).withColumnsRenamed({"pred": "Normal", "ref": "Simple"}).withColumn("split", fx.split_of("conv_id"))
    return P.load_pairs(wl, "wikilarge", "conv_id").select(*IDS, "complex", "simple", "split")


@register("load_multisim", fx.duck_with("v_pairs") +
          f"SELECT conv_id, turn, pred AS complex, ref AS simple, {_THREE.format(c='conv_id')} AS split FROM v_pairs")
def q_load_multisim(spark, d):
    """C11: no splits given, so the pairs are split anew."""
    ms = fx.v_pairs(spark, d).withColumnsRenamed({"pred": "original", "ref": "simple"})
    return P.load_pairs(ms, "multisim", "conv_id").select(*IDS, "complex", "simple", "split")


_CSV_HASH = "('0x'||substr(md5(md5(pred || '|' || ref) || '42'),1,8))::BIGINT"


@register("load_csv_pairs", fx.duck_with("v_pairs") +
          f"SELECT pred AS complex, ref AS simple, CASE WHEN h < round(0.7 * 4294967296) THEN 'train' WHEN h < round(0.9 * 4294967296) THEN 'validation' "
          f"ELSE 'test' END AS split FROM (SELECT pred, ref, {_CSV_HASH} AS h FROM v_pairs)")
def q_load_csv_pairs(spark, d):
    """Pairs through a CSV file with other column names, split 70/20/10."""
    path = scratch_dir(spark, "pairs-csv")
    io.export_csv(fx.v_pairs(spark, d).selectExpr("pred as hard", "ref as easy"), path, "hard")
    return P.load_csv_pairs(spark, path, {"train": 0.7, "validation": 0.2, "test": 0.1})


@register("write_splits_again", fx.duck_with("v_scotus") + "SELECT doc_id, label, split FROM v_scotus")
def q_write_splits_again(spark, d):
    """A finished table is not written again, and is the first candidate found."""
    path = scratch_dir(spark, "splits") + "/table"
    rows = fx.v_scotus(spark, d).select("doc_id", "label", "split")
    io.write_splits(rows, path)
    io.write_splits(rows.where("label = 1"), path)
    return io.resolve_source(spark, [path + "-missing", path]).select("doc_id", "label", "split")


@register("export_first_rows", fx.duck_with("v_scotus") +
          "SELECT doc_id::VARCHAR AS doc_id, text FROM v_scotus WHERE split = 'train' ORDER BY v_scotus.doc_id LIMIT 50")
def q_export_first_rows(spark, d):
    """The first 50 rows of a split as CSV, read again."""
    path = scratch_dir(spark, "export")
    io.export_csv(fx.v_scotus(spark, d).select("doc_id", "text", "split"), path, "doc_id", split="train", n=50)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("doc_id", "text")


@register("picked_columns", f"SELECT doc_id, {D.word_count('text')} AS n_words FROM documents")
def q_picked_columns(spark, d):
    """The text column is found by its hints, required columns are checked."""
    docs = fx.table(spark, d, "documents")
    io.require_columns(docs, ["doc_id", "text"])
    column = io.pick_column(docs, "opinion", io.TEXT_HINTS_EXTRACTIVE)
    return docs.select("doc_id", M.word_count(column).alias("n_words"))


def _strip_s(token: str) -> str:
    return token[:-1] if token.endswith("s") else token


_STEMMED = "list_transform({t}, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' THEN x[:-2] ELSE x END)"


@register("rouge1_stemmed", fx.duck_with("v_pairs") +
          f", t AS (SELECT conv_id, turn, {_STEMMED.format(t=D.rouge_tokens('pred'))} AS p, {_STEMMED.format(t=D.rouge_tokens('ref'))} AS r FROM v_pairs), "
          "pc AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS g FROM t) GROUP BY ALL), "
          "rc AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(r) AS g FROM t) GROUP BY ALL), "
          "m AS (SELECT conv_id, turn, sum(least(pc.c, rc.c)) AS m FROM pc JOIN rc USING (conv_id, turn, g) GROUP BY ALL) "
          "SELECT conv_id, turn, round(coalesce(m, 0) / greatest(len(p), 1), 6) AS precision, round(coalesce(m, 0) / greatest(len(r), 1), 6) AS recall "
          "FROM t LEFT JOIN m USING (conv_id, turn)")
def q_rouge1_stemmed(spark, d):
    """ROUGE-1 on stemmed tokens (longer than 3 characters), any stemmer."""
    r = M.rouge_n(fx.v_pairs(spark, d), IDS, "pred", "ref", (1,), stemmer=_strip_s)
    return r.select(*IDS, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
