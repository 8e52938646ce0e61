"""Scoring: softmax/argmax on logit arrays, label lookup, pluggable model scorers
with fall-backs, the dictionary simplifier and the document chain.

C3-C5, C10, C14, X6, W6, X18, A17.  Array math is native (higher-order
functions); a user-supplied model runs in an Arrow function of its input column, with
the model built once per Python worker.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.common import let, to_col
from corpuskit.functions.postprocess import post_process_summary
from corpuskit.functions.text import clean_text, safe_text, word_count
from corpuskit.operators import textrank

# Texts the reference returns on failure.
SUMMARY_ERROR = "Error: Could not generate summary."
SIMPLIFY_ERROR = "Error: Could not simplify text."
FALLBACK_PREFIX = "FALLBACK_"
# Dictionaries up to this many entries are inlined as a literal.
INLINE_TERMS_MAX = 10_000
MODEL_ROWS = 1024  # rows of a model call where the caller sets no number


def softmax(logits) -> Column:
    """Numerically stable softmax over one row's class axis."""
    def on_logits(lg):
        def on_exp(ex):
            return let(F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x),
                       lambda total: F.transform(ex, lambda x: x / total))
        return let(F.array_max(lg), lambda mx: let(F.transform(lg, lambda x: F.exp(x - mx)), on_exp))
    return let(to_col(logits), on_logits)


def argmax(values) -> Column:
    """0-based index of the first maximum."""
    return let(to_col(values), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("bigint"))


def classify(df: DataFrame, logits: str, task: str | Column, dim: DataFrame | None = None) -> DataFrame:
    """Logits -> softmax -> argmax + confidence -> label name."""
    from corpuskit.operators.labels import attach_label_names
    t = F.lit(task) if isinstance(task, str) and task not in df.columns else to_col(task)
    best = let(softmax(logits), lambda p: F.struct(argmax(p).alias("id"), F.array_max(p).alias("conf")))
    out = df.withColumn("task", t).withColumn("_best", best) \
        .withColumn("predicted_label_id", F.col("_best.id")) \
        .withColumn("confidence", F.col("_best.conf")).drop("_best")
    if dim is None:
        return out.withColumn("predicted_label_name", F.concat(
            F.lit("ID_"), F.col("predicted_label_id").cast("string"), F.lit("_NoMapForTask")))
    return attach_label_names(out, dim, task="task", label="predicted_label_id", out="predicted_label_name")


# -- pluggable scorers (C3 / C4) -------------------------------------------

_WORKER_MODELS: dict = {}


def _model(key, factory):
    # built once per Python worker process; a factory that fails is not tried again there
    if key not in _WORKER_MODELS:
        try:
            _WORKER_MODELS[key] = (factory(), None)
        except Exception as e:  # noqa: BLE001 — the failure becomes a value
            _WORKER_MODELS[key] = (None, e)
    model, failure = _WORKER_MODELS[key]
    if failure is not None:
        raise failure
    return model


def _scored(model, texts: pd.Series) -> list:
    out = list(model(texts))
    if len(out) != len(texts):
        raise ValueError(f"the model gave {len(out)} results for {len(texts)} texts")
    return out


def scored_column(factories: Sequence[Callable[[], Callable[[pd.Series], pd.Series]]], input_col, output_type: str = "string",
                  sentinel=None, batch_rows: int | None = None, fallback_prefix: str | None = None) -> Column:
    """``struct<output, backend, error>`` of ``score_with_model`` as a column.  Only the input goes to Python; an Arrow
    batch is turned into Python values by at most ``batch_rows`` (else MODEL_ROWS) rows, once a model is there to see them."""
    from pyspark.sql.pandas.types import to_arrow_type
    made = to_arrow_type(T._parse_datatype_string(output_type))
    token = uuid.uuid4().hex  # of this call: a worker never serves another call's model
    facts = list(factories)

    def marked(v, i):
        if i == 0 or fallback_prefix is None or v is None:
            return v
        return {**v, "label": f"{fallback_prefix}{v['label']}"} if isinstance(v, dict) else f"{fallback_prefix}{v}"

    def one(column: pa.Array) -> pa.Array:
        n, texts = len(column), None
        result, backend, error = [sentinel] * n, [None] * n, [None] * n
        left = list(range(n))
        for i, f in enumerate(facts):
            if not left:
                break
            got, failed = {}, []
            try:
                model = _model((token, i), f)
            except Exception as e:  # noqa: BLE001
                failed = [(j, e) for j in left]
            else:
                texts = column.to_pandas() if texts is None else texts
                try:
                    got = dict(zip(left, _scored(model, texts.iloc[left])))
                except Exception:  # noqa: BLE001
                    for j in left:
                        try:
                            got[j] = _scored(model, texts.iloc[[j]])[0]
                        except Exception as e:  # noqa: BLE001
                            failed.append((j, e))
            for j, v in got.items():
                result[j], backend[j], error[j] = marked(v, i), "primary" if i == 0 else f"fallback_{i}", None
            for j, e in failed:
                error[j] = error[j] or f"{type(e).__name__}: {e}"
            left = [j for j, _ in failed]
        values = pd.Series(result)
        return pa.StructArray.from_arrays([pa.Array.from_pandas(values, mask=values.isnull(), type=made), pa.array(backend, pa.string()),
                                           pa.array(error, pa.string())], ["output", "backend", "error"])

    def run(column: pa.Array) -> pa.Array:
        step = batch_rows or MODEL_ROWS
        return pa.concat_arrays([one(column.slice(at, step)) for at in range(0, max(len(column), 1), step)])
    udf = F.arrow_udf(run, f"struct<output: {T._parse_datatype_string(output_type).simpleString()}, backend: string, error: string>")
    return udf.asNondeterministic()(to_col(input_col))


def score_with_model(df: DataFrame, factories: Sequence[Callable[[], Callable[[pd.Series], pd.Series]]],
                     input_col: str, output_col: str = "output", output_type: str = "string",
                     sentinel=None, keep: Sequence[str] | None = None,
                     batch_rows: int | None = None, fallback_prefix: str | None = None) -> DataFrame:
    """C3 + C4: run a caller-supplied batch scorer over the column.  A batch that fails is
    tried again row by row, and a row that fails alone goes on to the next factory, so
    every text falls back on its own whatever the batches are.  The result carries the
    back-end that answered and, on total failure, the primary back-end's error text
    instead of raising (X18).  ``fallback_prefix`` (e.g. ``FALLBACK_``) marks string
    outputs (or the ``label`` field of a struct) of a fall-back back-end.

    Each factory returns ``fn(pd.Series) -> pd.Series``.  Rows stay where they are: no
    shuffle; the model sees at most ``batch_rows`` rows per call.
    """
    keep = list(keep if keep is not None else df.columns)
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    scored = scored_column(factories, input_col, output_type, sentinel, batch_rows, fallback_prefix)
    return df.select(*keep, scored.alias("_scored")).select(*keep, F.col("_scored.output").alias(output_col), "_scored.backend", "_scored.error")


# -- default deterministic back-ends (native expressions) ------------------

def length_logits(text, is_clean: bool = False) -> Column:
    """Default classifier back-end: two logits from the word-length profile
    (share of words up to 4 chars vs. longer words), scaled by 4."""
    def on_words(w):
        n = F.greatest(F.size(F.filter(w, lambda x: x != "")), F.lit(1))
        short = F.size(F.filter(w, lambda x: (F.length(x) > 0) & (F.length(x) <= 4)))
        long_ = F.size(F.filter(w, lambda x: F.length(x) > 4))
        return F.array((short * 4.0 / n).cast("double"), (long_ * 4.0 / n).cast("double"))
    return let(F.split(to_col(text) if is_clean else clean_text(text), " "), on_words)


def dictionary_simplify(df: DataFrame, id_col: str, text: str, terms: DataFrame,
                        out: str = "simplified") -> DataFrame:
    """C14: replace dictionary terms word by word (case-insensitive match on the
    lower-cased word); other words are kept.

    A term given more than once means its smallest plain word.  A dictionary of at
    most INLINE_TERMS_MAX terms is looked up in place; of a longer one each row gets
    the terms that its id's texts hold (joined; broadcast only after a size check) and
    looks them up, with the same result.  Rows that repeat an id, or have none, stay
    rows of their own; null texts become empty.
    """
    from corpuskit.operators.labels import checked_broadcast
    terms = terms.where(F.col("term").isNotNull() & F.col("plain").isNotNull()).groupBy("term").agg(F.min("plain").alias("plain"))
    small = terms.limit(INLINE_TERMS_MAX + 1).collect()
    if len(small) <= INLINE_TERMS_MAX:
        # proven-small dictionary: inline it as a literal, no shuffle at all
        return df.withColumn(out, dictionary_simplify_col(text, {r.term: r.plain for r in small}))
    t = checked_broadcast(terms.select(F.col("term").alias("_term"), F.col("plain").alias("_plain")))
    words = df.select(F.col(id_col).alias("_dict_id"), F.explode(F.array_distinct(F.transform(F.split(clean_text(text), " "), F.lower))).alias("_word"))
    held = (words.join(t, F.col("_word") == F.col("_term")).select("_dict_id", "_term", "_plain").distinct()
            .groupBy("_dict_id").agg(F.map_from_entries(F.collect_list(F.struct("_term", "_plain"))).alias("_dict_held")))
    return (df.join(held, F.col(id_col).eqNullSafe(F.col("_dict_id")), "left")
            .withColumn(out, _replace_words(text, lambda w: F.try_element_at("_dict_held", w))).drop("_dict_id", "_dict_held"))


def _replace_words(text, plain: Callable) -> Column:
    """The cleaned text with each word replaced by ``plain`` of its lower case, where that is not null."""
    words = F.split(clean_text(text), " ")
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.coalesce(plain(F.lower(w)), w)), " "), F.lit(""))


def dictionary_simplify_col(text, terms: dict[str, str]) -> Column:
    """C14 for a small, fixed dictionary: a per-row lookup, no shuffle.

    Spark searches a map entry by entry, so the terms are dealt by crc32 to as many
    small maps as there are terms and a word looks into one of them."""
    n = max(1, len(terms))
    parts: list[dict[str, str]] = [{} for _ in range(n)]
    for term, plain in terms.items():
        parts[zlib.crc32(term.encode()) % n][term] = plain
    dealt = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return _replace_words(text, lambda w: F.try_element_at(F.get(dealt, (F.crc32(w.cast("binary")) % n).cast("int")), w))


def process_document(df: DataFrame, id_col: str = "doc_id", text: str = "text", task: str = "scotus",
                     dim: DataFrame | None = None, terms: dict[str, str] | None = None,
                     classifiers: Sequence[Callable] | None = None, summarizers: Sequence[Callable] | None = None,
                     simplifiers: Sequence[Callable] | None = None, batch_rows: int | None = None,
                     num_sentences: int = 5, min_sentence_length: int = 5, stop_words: list[str] | str | None = "english",
                     max_iter: int = textrank.MAX_ITER, tol: float | None = textrank.TOL) -> DataFrame:
    """Classify -> summarize -> post-process -> simplify the *summary* -> record.

    ``classifiers`` / ``summarizers`` / ``simplifiers``: model factories as in
    ``score_with_model``, the later ones fall-backs (a classifier gives a dict of
    ``label`` and ``score``).  A text that all classifiers fail on has no label, and the
    first one's ``error``; summaries and simplifications that fail are the fixed texts.
    Without factories the defaults are native: length logits, TextRank over the whole
    text, and the dictionary ``terms``.  No shuffle but the label-dimension join.
    """
    if simplifiers is None and terms is None:
        raise ValueError("give simplifiers or a dictionary of terms")
    if isinstance(stop_words, str):
        stop_words = textrank.english_stop_words(df.sparkSession)
    # the cleaned text feeds both back-ends: computed once in its own projection
    c = df.select(id_col, F.col(text).alias("_text"), clean_text(safe_text(text)).alias("_clean"))
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    # both read the text: asked for together, one Python worker a task serves both
    models = {}
    if classifiers is not None:
        models["_class"] = scored_column(classifiers, "_text", "struct<label:string,score:double>", batch_rows=batch_rows, fallback_prefix=FALLBACK_PREFIX)
    if summarizers is not None:
        models["_made"] = scored_column(summarizers, "_text", sentinel=SUMMARY_ERROR, batch_rows=batch_rows)
    c = c.withColumns(models) if models else c
    if classifiers is None:
        c = classify(c.withColumn("_logits", length_logits("_clean", is_clean=True)), "_logits", task, dim)
        c = c.withColumn("error", F.lit(None).cast("string")).drop("_logits")
    else:
        c = c.withColumns({"task": F.lit(task), "predicted_label_id": F.lit(None).cast("bigint"), "error": F.col("_class.error"),
                           "predicted_label_name": F.col("_class.output.label"), "confidence": F.col("_class.output.score")}).drop("_class")
    c = c.withColumnRenamed("error", "_error")
    if summarizers is None:
        c = textrank.with_summary(c, "_clean", "_raw", num_sentences, min_sentence_length, stop_words, max_iter=max_iter, tol=tol, sep="<n>")
    else:
        c = c.withColumn("_raw", F.col("_made.output")).drop("_made")
    c = c.withColumn("summary", F.when(F.col("_raw") == SUMMARY_ERROR, F.col("_raw")).otherwise(post_process_summary("_raw"))).drop("_raw", "_text", "_clean")
    if simplifiers is None:
        c = c.withColumn("simplified_summary", dictionary_simplify_col("summary", terms))
    else:
        c = score_with_model(c, simplifiers, "summary", "simplified_summary", sentinel=SIMPLIFY_ERROR, batch_rows=batch_rows).drop("backend", "error")
    return c.select(
        id_col, "task", "predicted_label_id", "predicted_label_name", "confidence", F.col("_error").alias("error"), "summary",
        "simplified_summary", word_count("summary").alias("summary_words"),
        word_count("simplified_summary").alias("simplified_words"))


# The lines of the report.
REPORT_TITLE = "=== LEGAL DOCUMENT ANALYSIS ==="


def report_text(df: DataFrame) -> Column:
    """The text report of one pipeline result; a failed classification reads ``Error`` and 0."""
    return F.concat(
        F.lit(REPORT_TITLE + "\n\nCLASSIFICATION: "), F.coalesce(F.col("predicted_label_name"), F.lit("Error")),
        F.lit("\nConfidence: "), F.format_string("%.4f", F.coalesce(F.col("confidence"), F.lit(0.0))),
        F.lit("\n\nSUMMARY:\n"), F.coalesce(F.col("summary"), F.lit("")),
        F.lit("\n\nSIMPLIFIED SUMMARY:\n"), F.coalesce(F.col("simplified_summary"), F.lit("")))
