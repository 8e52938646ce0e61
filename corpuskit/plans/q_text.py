"""Catalog entries for text primitives, encoding, post-processing and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as X
from corpuskit.functions.postprocess import post_process_summary, post_process_training, renumber_points
from corpuskit.operators import encode as E
from corpuskit.operators import pairs as P
from corpuskit.plans import duck as D
from corpuskit.plans import fixtures as fx
from corpuskit.plans.catalog import register

V_POINTS = {"v_points": f"SELECT doc_id, {D.points_text()} AS summary FROM documents"}


def _docs(spark, d):
    return fx.documents(spark, d)


@register("clean_text", f"SELECT doc_id, {D.clean_text('text')} AS clean FROM documents")
def q_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_text("text").alias("clean"))


@register("sentence_split", f"SELECT doc_id, len(a) AS n_sentences, "
          "list_sum(list_transform(a, lambda s: length(s)))::BIGINT AS n_chars FROM "
          f"(SELECT doc_id, {D.split_sentences(D.clean_text('text'))} AS a FROM documents)")
def q_sentence_split(spark, d):
    a = X.split_sentences(X.clean_text("text"))
    return _docs(spark, d).select("doc_id", F.size(a).cast("bigint").alias("n_sentences"),
                                  F.aggregate(F.transform(a, F.length), F.lit(0).cast("bigint"),
                                              lambda acc, x: acc + x).alias("n_chars"))


@register("sentence_counts", f"SELECT doc_id, len({D.keep_long_sentences(D.split_sentences(D.clean_text('text')))}) "
          "AS n_kept FROM documents")
def q_sentence_counts(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.size(X.keep_long_sentences(X.split_sentences(X.clean_text("text")))).cast("bigint").alias("n_kept"))


@register("sentences", "SELECT doc_id, (i - 1)::INTEGER AS idx, a[i] AS sentence FROM ("
          f"SELECT doc_id, {D.keep_long_sentences(D.split_sentences(D.clean_text('text')))} AS a FROM documents), "
          "LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)")
def q_sentences(spark, d):
    from corpuskit.operators.textrank import sentences
    return sentences(_docs(spark, d), "doc_id", "text").select("doc_id", "idx", "sentence")


@register("word_count", f"SELECT doc_id, {D.word_count('text')} AS n_words FROM documents")
def q_word_count(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count("text").alias("n_words"))


@register("rfind", f"SELECT doc_id, {D.rfind('text', '.')} AS last_period, {D.rfind('text', ' and ')} AS last_and, "
          f"{D.rfind('text', ',')} AS last_comma FROM documents")
def q_rfind(spark, d):
    return _docs(spark, d).select("doc_id", X.rfind("text", ".").alias("last_period"),
                                  X.rfind("text", " and ").alias("last_and"), X.rfind("text", ",").alias("last_comma"))


@register("line_helpers", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in V_POINTS.items()) +
          " SELECT doc_id, len(l) AS n_lines, "
          f"len(list_filter(l, lambda x: {D.starts_with_point('x')})) AS n_point_lines, "
          f"array_to_string(list_transform(l, lambda x: lower({D.strip('x')})), '|') AS lowered "
          "FROM (SELECT doc_id, string_split(replace(summary, '<n>', chr(10)), chr(10)) AS l FROM v_points)")
def q_line_helpers(spark, d):
    pts = fx.v_points(spark, d)
    lines = F.split(F.replace(F.col("summary"), F.lit("<n>"), F.lit("\n")), "\n")
    return pts.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"),
                      F.size(F.filter(lines, X.starts_with_point)).cast("bigint").alias("n_point_lines"),
                      F.array_join(F.transform(lines, lambda x: F.lower(X.strip_ws(x))), "|").alias("lowered"))


@register("safe_text", fx.duck_with("v_casehold") +
          "SELECT doc_id, coalesce(label::VARCHAR, '') AS label_text FROM v_casehold")
def q_safe_text(spark, d):
    return fx.v_casehold(spark, d).select("doc_id", X.safe_text("label").alias("label_text"))


@register("model_prefix", "SELECT doc_id, 'summarize: ' || text AS t5_input, length(text) AS pegasus_len FROM documents")
def q_model_prefix(spark, d):
    return _docs(spark, d).select("doc_id", X.model_prefix("text", "t5-small").alias("t5_input"),
                                  F.length(X.model_prefix("text", "google/pegasus-large")).cast("bigint")
                                  .alias("pegasus_len"))


@register("preview", f"SELECT doc_id, {D.preview('text', 500)} AS preview_500, {D.preview('text', 100)} AS preview_100 "
          "FROM documents")
def q_preview(spark, d):
    return _docs(spark, d).select("doc_id", X.preview("text", 500).alias("preview_500"),
                                  X.preview("text", 100).alias("preview_100"))


@register("avg_words", fx.duck_with("v_pairs") +
          f"SELECT round(avg({D.word_count('pred')}), 1) AS avg_text_words, "
          f"round(avg({D.word_count('ref')}), 1) AS avg_summary_words, count(*) AS n_rows FROM v_pairs")
def q_avg_words(spark, d):
    p = fx.v_pairs(spark, d)
    return p.agg(F.round(F.avg(X.word_count("pred")), 1).alias("avg_text_words"),
                 F.round(F.avg(X.word_count("ref")), 1).alias("avg_summary_words"),
                 F.count("*").alias("n_rows"))


def _duck_encode(x: str, length: int, vocab: int) -> str:
    toks = f"{D.lower_tokens(x)}[1:{length}]"
    ids = (f"list_transform({toks}, lambda t: (('0x'||substr(md5(t),1,8))::BIGINT % {vocab - E.RESERVED} "
           f"+ {E.RESERVED})::INTEGER)")
    n = f"len({toks})"
    return (f"array_to_string(list_concat({ids}, list_transform(range({length} - {n}), lambda z: 0)), ',') AS input_ids, "
            f"array_to_string(list_concat(list_transform(range({n}), lambda z: 1), "
            f"list_transform(range({length} - {n}), lambda z: 0)), ',') AS attention_mask")


@register("encode_fixed_length", f"SELECT doc_id, {_duck_encode('text', 512, E.DEFAULT_VOCAB)} FROM documents")
def q_encode_fixed_length(spark, d):
    enc = E.encode_fixed_length(_docs(spark, d), "text", 512)
    return enc.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


@register("mask_padding", fx.duck_with("v_pairs") +
          "SELECT conv_id, turn, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') "
          "AS labels, array_to_string(ids, ',') AS restored FROM (SELECT conv_id, turn, "
          "string_split(" + _duck_encode("ref", 128, E.DEFAULT_VOCAB).split(" AS input_ids")[0] + ", ',')::INTEGER[] AS ids "
          "FROM v_pairs)")
def q_mask_padding(spark, d):
    enc = E.encode_fixed_length(fx.v_pairs(spark, d), "ref", 128)
    masked = X.mask_padding("input_ids")
    return enc.select("conv_id", "turn", F.array_join(masked, ",").alias("labels"),
                      F.array_join(X.unmask_padding(masked), ",").alias("restored"))


@register("post_process", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in V_POINTS.items()) +
          f" SELECT doc_id, {D.post_process_summary('summary')} AS summary FROM v_points")
def q_post_process(spark, d):
    return fx.v_points(spark, d).select("doc_id", post_process_summary("summary").alias("summary"))


@register("post_process_train", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in V_POINTS.items()) +
          f" SELECT doc_id, {D.post_process_training("replace(summary, '<n>', chr(10))")} "
          "AS summary FROM v_points")
def q_post_process_train(spark, d):
    t = F.replace(F.col("summary"), F.lit("<n>"), F.lit("\n"))
    return fx.v_points(spark, d).select("doc_id", post_process_training(t).alias("summary"))


@register("renumber_points", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in V_POINTS.items()) +
          f" SELECT doc_id, array_to_string({D.renumber_points('string_split(summary, ' + repr('<n>') + ')')}, chr(10)) "
          "AS points FROM v_points")
def q_renumber_points(spark, d):
    return fx.v_points(spark, d).select(
        "doc_id", F.array_join(renumber_points(F.split(F.col("summary"), "<n>")), "\n").alias("points"))


@register("rename_pairs", fx.duck_with("v_pairs") + "SELECT conv_id, turn, pred AS complex, ref AS simple FROM v_pairs")
def q_rename_pairs(spark, d):
    wl = fx.v_pairs(spark, d).withColumnsRenamed({"pred": "Normal", "ref": "Simple"})
    return P.rename_pairs(wl, "wikilarge").select("conv_id", "turn", "complex", "simple")


@register("first_reference", fx.duck_with("v_turk") +
          "SELECT conv_id, original AS complex, simplifications[1] AS simple FROM v_turk WHERE len(simplifications) > 0")
def q_first_reference(spark, d):
    return P.first_reference(fx.v_turk(spark, d)).select("conv_id", "complex", "simple")


@register("drop_incomplete_pairs", fx.duck_with("v_turk") +
          "SELECT conv_id, original AS complex, simplifications[1] AS simple FROM v_turk "
          "WHERE original IS NOT NULL AND simplifications[1] IS NOT NULL")
def q_drop_incomplete_pairs(spark, d):
    t = fx.v_turk(spark, d).select("conv_id", F.col("original").alias("complex"),
                                   F.get(F.col("simplifications"), 0).alias("simple"))
    return P.drop_incomplete_pairs(t)


_THREE = ("CASE WHEN " + fx.duck_bucket("conv_id", "42") + " < 80 THEN 'train' WHEN "
          + fx.duck_bucket("conv_id", "42b") + " < 50 THEN 'validation' ELSE 'test' END")


@register("load_simplification", fx.duck_with("v_turk") +
          f"SELECT conv_id, original AS complex, simplifications[1] AS simple, {_THREE} AS split FROM v_turk "
          "WHERE len(simplifications) > 0")
def q_load_simplification(spark, d):
    return P.load_pairs(fx.v_turk(spark, d), "turk", "conv_id", 42).select("conv_id", "complex", "simple", "split")
