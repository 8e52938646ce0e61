"""Extractive summarization by TextRank (C2) and its parts.

Sentence similarity is TF-IDF cosine, ``Q = W Wᵀ`` with ``W`` the L2-normalised
sentence-term matrix of one document.  PageRank only needs products with ``Q``,
and ``Q r = W (Wᵀ r)``, so every round is two sparse aggregations over the
``(doc, sentence, term, weight)`` table: no sentence pairs are ever formed and
the work per round is linear in the number of term occurrences.

A document stays one row with an array of sentences; its rounds run where the row is
(numpy ``bincount`` mat-vecs in an Arrow-batched function), so nothing is shuffled.  The
parts (X4, X5, A14, A15, J6) are also there as DataFrame operators over sentences, flat or nested: a nested
frame has one row a document, ``(doc_id, rows)``, and its texts are shuffled once, by their document's id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import clean_text, keep_long_clean_sentences, lower_tokens, safe_text, split_sentences

# PageRank damping, tolerance and iteration limit of the reference
# library defaults; fallback texts.
ALPHA = 0.85
TOL = 1e-6
MAX_ITER = 100
TRIM_CHARS = 500
TRIM_SUFFIX = "... (trimmed)"
SCORE_DIGITS = 6
SLICE = 1 << 18  # terms that are handled at once


def english_stop_words(spark) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords("english"))


def sentences(df: DataFrame, id_col: str, text: str, min_words: int = 5, nested: bool = False) -> DataFrame:
    """W3 + X1-X3: ``(id, idx, sentence)`` of the kept sentences, in order.  With ``nested`` a document
    stays one row ``(doc_id, rows)``, where rows that repeat an id are one document."""
    kept = keep_long_clean_sentences(split_sentences(clean_text(text)), min_words)
    if not nested:
        return df.select(F.col(id_col).alias("doc_id"), F.posexplode(kept).alias("idx", "sentence"))
    one = df.select(F.col(id_col).alias("doc_id"), F.transform(kept, lambda s, i: F.struct(i.alias("idx"), s.alias("sentence"))).alias("rows"))
    return one.groupBy("doc_id").agg(F.flatten(F.collect_list("rows")).alias("rows"))


def _nested(df: DataFrame, *columns: str) -> DataFrame:
    """One row a document, ``(doc_id, rows)``; a frame that has this shape stays as it is."""
    if "rows" in df.columns:
        return df
    return df.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def flat(df: DataFrame) -> DataFrame:
    """The rows of a nested frame."""
    return df.select("doc_id", F.inline("rows"))


def _shaped_as(given: DataFrame, out: DataFrame) -> DataFrame:
    return out if "rows" in given.columns else flat(out)


def _udf(run, kind: str):
    # generators infer filters from their input: marked so that these do not run the function once more
    return F.arrow_udf(run, kind).asNondeterministic()


def _with_rows(docs: DataFrame, rows: Column) -> DataFrame:
    from corpuskit.session import ship_package
    ship_package(docs.sparkSession)
    return docs.select("doc_id", rows.alias("rows"))


def term_counts(sents: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Raw term frequency per sentence ``(doc_id, idx, term, tf)``; nested where ``sents`` is."""
    docs = _nested(sents, "idx", "sentence")
    udf = _udf(_count_rows, "array<struct<idx: int, term: string, tf: bigint>>")
    return _shaped_as(sents, _with_rows(docs, udf(F.col("rows.idx"), _tokens_of(F.col("rows.sentence"), stop_words))))


def sentence_counts(sents: DataFrame) -> DataFrame:
    if "rows" in sents.columns:
        return sents.select("doc_id", F.size("rows").cast("bigint").alias("n")).where("n > 0")
    return sents.groupBy("doc_id").agg(F.count("*").alias("n"))


def doc_frequency(tc: DataFrame) -> DataFrame:
    """In how many sentences of its document each term occurs."""
    if "rows" not in tc.columns:
        return tc.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    return flat(_with_rows(tc, _udf(_frequency_rows, "array<struct<term: string, df: bigint>>")(F.col("rows.term"))))


def _weighted(sents: DataFrame, stop_words, n: DataFrame | None, run, kind: str) -> DataFrame:
    docs = _nested(sents, "idx", "sentence").where(F.col("doc_id").isNotNull())
    docs = docs.join(n, "doc_id") if n is not None else docs.withColumn("n", F.size("rows"))
    udf = _udf(run, f"array<struct<{kind}>>")
    return _shaped_as(sents, _with_rows(docs, udf(F.col("rows.idx"), _tokens_of(F.col("rows.sentence"), stop_words), F.col("n").cast("bigint"))))


def tfidf(sents: DataFrame, stop_words: list[str] | None = None, n: DataFrame | None = None) -> DataFrame:
    """Smooth-idf TF-IDF per sentence, L2-normalised:
    ``w = tf·(ln((1+n)/(1+df))+1) / ‖·‖``.  Returns ``(doc_id, idx, term, w)``, nested where ``sents`` is.

    The texts move once, to their document; a document's weights are figured where it is."""
    return _weighted(sents, stop_words, n, _tfidf_rows, "idx: int, term: string, w: double")


def tfidf_raw(sents: DataFrame, stop_words: list[str] | None = None, n: DataFrame | None = None) -> DataFrame:
    """Un-normalised TF-IDF ``x = tf·(ln((1+n)/(1+df))+1)`` per (doc, sentence, term); nested where ``sents`` is."""
    return _weighted(sents, stop_words, n, _raw_rows, "term: string, idx: int, tf: bigint, df: bigint, n: bigint, x: double")


def sentence_norms(x: DataFrame) -> DataFrame:
    """L2 norm of each sentence's raw TF-IDF vector."""
    if "rows" not in x.columns:
        return x.groupBy("doc_id", "idx").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return flat(_with_rows(x, _udf(_norm_rows, "array<struct<idx: int, norm: double>>")(F.col("rows.idx"), F.col("rows.x"))))


def similarity_row_sums(w: DataFrame) -> DataFrame:
    """X5 aggregated: ``s_i = Σ_j cos(i, j)`` (self included) = ``w_i · Σ_j w_j``."""
    docs = _nested(w, "idx", "term", "w").where(F.col("doc_id").isNotNull())
    udf = _udf(_row_sum_rows, "array<struct<idx: int, s: double>>")
    return flat(_with_rows(docs, udf(F.col("rows.idx"), F.col("rows.term"), F.col("rows.w"))))


def adjacent_cosine(w: DataFrame) -> DataFrame:
    """X5/J6 for given pairs: cosine of each sentence with the next one; only the requested pairs are formed."""
    docs = _nested(w, "idx", "term", "w").where(F.col("doc_id").isNotNull())
    udf = _udf(_adjacent_rows, "array<struct<idx: int, cos_next: double>>")
    return flat(_with_rows(docs, udf(F.col("rows.idx"), F.col("rows.term"), F.col("rows.w"))))


# -- a document's figures where its row is ------------------------------------
# An Arrow batch is handled in runs of documents with about SLICE terms; an entry is a
# term of a sentence, and codes follow the order of the terms, so that sums do not
# depend on which documents share a batch.

def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(sizes: np.ndarray):
    part = (np.cumsum(sizes) - sizes) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return zip(bounds[:-1], bounds[1:])


def _in_runs(sizes: np.ndarray, one, *columns: pa.Array) -> pa.Array:
    return pa.concat_arrays([one(*[c.slice(a, b - a) for c in columns]) for a, b in _runs(sizes)])


def _token_sizes(tokens: pa.Array) -> np.ndarray:
    """Tokens of each document, which is a list of sentences."""
    ends = np.concatenate([[0], np.cumsum(_lengths(tokens.flatten()))])
    at = np.concatenate([[0], np.cumsum(_lengths(tokens))])
    return ends[at[1:]] - ends[at[:-1]]


def _coded(terms: pa.Array):
    d = terms.dictionary_encode()
    order = pc.array_sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[d.indices.to_numpy(zero_copy_only=False)], d.dictionary.take(pa.array(order))


def _entries(tokens: pa.Array, idx: np.ndarray | None = None):
    """``(document, sentence, code, tf)`` of the entries, in that order, and the terms by code."""
    sents = tokens.flatten()
    doc = np.repeat(np.arange(len(tokens)), _lengths(tokens))
    if idx is None:
        idx = np.arange(len(doc)) - np.repeat(np.cumsum(_lengths(tokens)) - _lengths(tokens), _lengths(tokens))
    sizes = _lengths(sents)
    code, terms = _coded(sents.flatten())
    span, t = int(idx.max(initial=0)) + 1, max(len(terms), 1)
    key, tf = np.unique(np.repeat(doc * span + idx, sizes) * t + code, return_counts=True)
    sent, code = np.divmod(key, t)
    doc, idx = np.divmod(sent, span)
    return doc, idx, code, tf, terms


def _numbered(doc: np.ndarray, other: np.ndarray):
    """Numbers of the pairs, and how many entries each has."""
    _, at, n = np.unique(doc * (int(other.max(initial=0)) + 1) + other, return_inverse=True, return_counts=True)
    return at, n


def _raw_weights(doc, code, tf, n: np.ndarray):
    at, df = _numbered(doc, code)
    return df[at], tf * (np.log((1.0 + n[doc]) / (1.0 + df[at])) + 1.0)


def _listed(docs: int, doc: np.ndarray, **columns) -> pa.Array:
    """One list of structs a document; ``doc`` ascends."""
    made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays(made, list(columns)))


def _first(doc: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Positions where a new pair begins."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]))


def _flat_int(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _count_rows(idx: pa.Array, tokens: pa.Array) -> pa.Array:
    def one(idx, tokens):
        doc, i, code, tf, terms = _entries(tokens, _flat_int(idx))
        return _listed(len(tokens), doc, idx=i.astype(np.int32), term=terms.take(pa.array(code)), tf=tf.astype(np.int64))
    return _in_runs(_token_sizes(tokens), one, idx, tokens)


def _frequency_rows(terms: pa.Array) -> pa.Array:
    def one(lists):
        code, terms = _coded(lists.flatten())
        t = max(len(terms), 1)
        key, df = np.unique(np.repeat(np.arange(len(lists)), _lengths(lists)) * t + code, return_counts=True)
        return _listed(len(lists), key // t, term=terms.take(pa.array(key % t)), df=df.astype(np.int64))
    return _in_runs(_lengths(terms), one, terms)


def _raw_rows(idx: pa.Array, tokens: pa.Array, n: pa.Array) -> pa.Array:
    def one(idx, tokens, n):
        doc, i, code, tf, terms = _entries(tokens, _flat_int(idx))
        n = n.to_numpy(zero_copy_only=False)
        df, x = _raw_weights(doc, code, tf, n)
        return _listed(len(tokens), doc, term=terms.take(pa.array(code)), idx=i.astype(np.int32), tf=tf.astype(np.int64), df=df.astype(np.int64),
                       n=n[doc].astype(np.int64), x=x)
    return _in_runs(_token_sizes(tokens), one, idx, tokens, n)


def _tfidf_rows(idx: pa.Array, tokens: pa.Array, n: pa.Array) -> pa.Array:
    def one(idx, tokens, n):
        doc, i, code, tf, terms = _entries(tokens, _flat_int(idx))
        _, x = _raw_weights(doc, code, tf, n.to_numpy(zero_copy_only=False))
        sent, _ = _numbered(doc, i)
        return _listed(len(tokens), doc, idx=i.astype(np.int32), term=terms.take(pa.array(code)), w=x / np.sqrt(np.bincount(sent, weights=x * x))[sent])
    return _in_runs(_token_sizes(tokens), one, idx, tokens, n)


def _summed(n: int, doc, i, values, name: str) -> pa.Array:
    """Sums of ``values`` per sentence."""
    sent, _ = _numbered(doc, i)
    order = np.argsort(sent, kind="stable")
    first = order[_first(doc[order], i[order])]
    return _listed(n, doc[first], idx=i[first].astype(np.int32), **{name: np.bincount(sent, weights=values)})


def _norm_rows(idx: pa.Array, x: pa.Array) -> pa.Array:
    def one(idx, x):
        doc, v = np.repeat(np.arange(len(idx)), _lengths(idx)), x.flatten().to_numpy(zero_copy_only=False)
        sums = _summed(len(idx), doc, _flat_int(idx), v * v, "norm")
        i, s = sums.values.flatten()
        return pa.ListArray.from_arrays(sums.offsets, pa.StructArray.from_arrays([i, pc.sqrt(s)], ["idx", "norm"]))
    return _in_runs(_lengths(idx), one, idx, x)


def _row_sum_rows(idx: pa.Array, terms: pa.Array, w: pa.Array) -> pa.Array:
    def one(idx, terms, w):
        doc, v = np.repeat(np.arange(len(idx)), _lengths(idx)), w.flatten().to_numpy(zero_copy_only=False)
        at, _ = _numbered(doc, _coded(terms.flatten())[0])
        return _summed(len(idx), doc, _flat_int(idx), v * np.bincount(at, weights=v)[at], "s")
    return _in_runs(_lengths(idx), one, idx, terms, w)


def _adjacent_rows(idx: pa.Array, terms: pa.Array, w: pa.Array) -> pa.Array:
    def one(idx, terms, w):
        doc, i, v = np.repeat(np.arange(len(idx)), _lengths(idx)), _flat_int(idx), w.flatten().to_numpy(zero_copy_only=False)
        code, t = _coded(terms.flatten())
        key = (doc * max(len(t), 1) + code) * (int(i.max(initial=0)) + 2) + i
        order = np.argsort(key, kind="stable")
        key, doc, i, v = key[order], doc[order], i[order], v[order]
        a = np.flatnonzero(key[1:] == key[:-1] + 1)  # the term stands in the next sentence too
        return _summed(len(idx), doc[a], i[a], v[a] * v[a + 1], "cos_next")
    return _in_runs(_lengths(idx), one, idx, terms, w)


# -- PageRank ---------------------------------------------------------------

def _ranks(tokens: pa.Array, alpha: float, max_iter: int, tol: float | None):
    """``(number of sentences of each document, ranks of all sentences, settled)`` of a run of documents,
    whose rounds run together.  A document settles at ``Σ|Δr| < n·tol`` and keeps its ranks from then on.
    Without any token there is nothing to rank by: equal ranks, not settled (document order decides)."""
    n = _lengths(tokens)
    home = np.repeat(np.arange(len(n)), n)
    doc, i, code, tf, _ = _entries(tokens)
    _, x = _raw_weights(doc, code, tf, n)
    sent, (term, _) = (np.cumsum(n) - n)[doc] + i, _numbered(doc, code)
    norm = np.sqrt(np.bincount(sent, weights=x * x, minlength=len(home)))
    w = x / norm[sent]
    s = np.bincount(sent, weights=w * np.bincount(term, weights=w)[term], minlength=len(home)) if len(w) else np.zeros(len(home))
    dang = s <= 0.0
    share = np.where(dang, 0.0, 1.0 / np.where(dang, 1.0, s))
    size = n[home].astype(np.float64)
    r = 1.0 / size
    some = np.bincount(doc, minlength=len(n)) > 0
    settled, active = np.where(n > 0, some, True) if tol is None else np.zeros(len(n), dtype=bool), some.copy()
    for _ in range(max_iter if len(w) else 0):
        v = np.bincount(term, weights=w * (r * share)[sent])
        y = np.bincount(sent, weights=w * v[term], minlength=len(home))
        lost = np.bincount(home[dang], weights=r[dang], minlength=len(n)) / np.maximum(n, 1)
        new = np.where(active[home], (1.0 - alpha) / size + alpha * (y + lost[home]), r)
        if tol is None:
            r = new
            continue
        done = active & (np.bincount(home, weights=np.abs(new - r), minlength=len(n)) < n * tol)
        r, settled, active = new, settled | done, active & ~done
        if not active.any():
            break
    return n, r, settled


def _tokens_of(sents, stop_words) -> Column:
    """TF-IDF tokens of each sentence."""
    def one(sentence):
        toks = lower_tokens(sentence)
        if stop_words:
            toks = F.filter(toks, lambda t: ~t.isin(*stop_words))
        return toks
    return F.transform(sents, one)


def _kept_sentences(cleaned, min_words: int) -> Column:
    return keep_long_clean_sentences(split_sentences(cleaned), min_words)


def rank_column(tokens: Column, alpha: float, max_iter: int, tol: float | None) -> Column:
    """``struct<rank: array<double>, converged: boolean>`` of a document held as one row."""
    def one(tokens: pa.Array) -> pa.Array:
        n, r, settled = _ranks(tokens, alpha, max_iter, tol)
        ranks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(r))
        return pa.StructArray.from_arrays([ranks, pa.array(settled)], ["rank", "converged"])

    def run(tokens: pa.Array) -> pa.Array:
        return _in_runs(_token_sizes(tokens), one, tokens)
    return _udf(run, "struct<rank: array<double>, converged: boolean>")(tokens)


def pick_column(tokens: Column, k: int, alpha: float, max_iter: int, tol: float | None) -> Column:
    """Positions of the ``k`` best sentences in document order.  Scores are compared
    as ``rank * n`` at SCORE_DIGITS digits, so equal scores tie (the earlier sentence
    wins) whatever the number of sentences; without convergence the first ``k`` stay."""
    def one(tokens: pa.Array) -> pa.Array:
        n, r, settled = _ranks(tokens, alpha, max_iter, tol)
        out, at = [], 0
        for size, ok in zip(n.tolist(), settled.tolist()):
            if size <= k or not ok:
                out.append(list(range(min(size, k))))
            else:
                score = np.round(r[at:at + size] * size, SCORE_DIGITS)
                out.append(sorted(np.argsort(-score, kind="stable")[:k].tolist()))
            at += size
        return pa.array(out, pa.list_(pa.int32()))

    def run(tokens: pa.Array) -> pa.Array:
        return _in_runs(_token_sizes(tokens), one, tokens)
    return _udf(run, "array<int>")(tokens)


def _prepared(df: DataFrame, id_col: str, text: str, min_words: int, stop_words) -> DataFrame:
    """One row a document: id, cleaned text, kept sentences, their tokens.  A null text is
    an empty one (P5)."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), clean_text(safe_text(text)).alias("_clean"))
    docs = docs.withColumn("_sents", _kept_sentences("_clean", min_words))
    return docs.withColumn("_toks", _tokens_of("_sents", stop_words))


def textrank_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_sentence_length: int = 5,
                    stop_words: list[str] | str | None = "english", alpha: float = ALPHA,
                    max_iter: int = MAX_ITER, tol: float | None = TOL) -> DataFrame:
    """C2 scores: ``(doc_id, idx, rank, converged, n)`` for every kept sentence.

    ``tol=None`` runs exactly ``max_iter`` rounds (the fixed recipe used by the
    oracle); otherwise a document stops at ``Σ|Δr| < n·tol`` like the reference
    library, and a document that never converges is flagged.  A document is one row
    from the scan to the result: no shuffle.
    """
    if isinstance(stop_words, str):
        stop_words = english_stop_words(df.sparkSession)
    docs = _prepared(df, id_col, text, min_sentence_length, stop_words)
    r = docs.select("doc_id", rank_column(F.col("_toks"), alpha, max_iter, tol).alias("r"))
    return r.select("doc_id", F.posexplode("r.rank").alias("idx", "rank"), F.col("r.converged").alias("converged"),
                    F.size("r.rank").alias("n"))


def with_summary(df: DataFrame, clean: str, out: str, num_sentences: int = 5, min_sentence_length: int = 5, stop_words: list[str] | None = None,
                 alpha: float = ALPHA, max_iter: int = MAX_ITER, tol: float | None = TOL, sep: str = " ") -> DataFrame:
    """``df`` with the TextRank summary of its cleaned text column ``clean``; rows stay where they are."""
    from corpuskit.session import ship_package
    ship_package(df.sparkSession)
    d = df.withColumn("_sents", _kept_sentences(F.col(clean), min_sentence_length))
    d = d.withColumn("_toks", _tokens_of(F.col("_sents"), stop_words))
    d = d.withColumn("_pick", pick_column(F.col("_toks"), num_sentences, alpha, max_iter, tol))
    fallback = F.concat(F.substring(clean, 1, TRIM_CHARS), F.lit(TRIM_SUFFIX))
    picked = F.array_join(F.transform("_pick", lambda i: F.get("_sents", i)), sep)
    return d.withColumn(out, F.when(F.size("_sents") == 0, fallback).otherwise(picked)).drop("_sents", "_toks", "_pick")


def textrank_summarize(df: DataFrame, id_col: str = "doc_id", text: str = "text", num_sentences: int = 5,
                       min_sentence_length: int = 5, stop_words: list[str] | str | None = "english",
                       alpha: float = ALPHA, max_iter: int = MAX_ITER, tol: float | None = TOL) -> DataFrame:
    """``(doc_id, summary)`` — TextRank top-k in document order, with the
    reference's edge rules: no sentence -> first 500 chars + marker; fewer than k
    -> all sentences; non-convergence / empty vocabulary -> document order.  No shuffle."""
    if isinstance(stop_words, str):
        stop_words = english_stop_words(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), clean_text(safe_text(text)).alias("_clean"))
    return with_summary(docs, "_clean", "summary", num_sentences, min_sentence_length, stop_words, alpha, max_iter, tol).select("doc_id", "summary")
