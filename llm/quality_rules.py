"""Quality rules: statistics of whole texts, judged by an isolation forest.

Method: isolation forest on rule statistics. Random axis-parallel splits isolate a
document that differs from the others in few steps; the mean path length over all
trees gives the anomaly score ``2 ** (-mean path / c(sample))``. The forest is fitted
on ``trees * SAMPLE`` rows (a bounded sample: those with the smallest hash of their
statistics and id), the threshold is set from all labelled rows: among the thresholds
that keep at least ``keep_good`` of the rows labelled good, the one that rejects most
of the rows labelled bad. Without such labels nothing is rejected by the forest.

Statistics are counted once over whole texts and written to the shared folder;
fitting, calibration and the verdict read only them.

Defined cases: null and empty texts have no words and fail the base rule; repeated
rows are rows of their own; a null id has no label; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import hash_sample, ids_and_text, saved, ship
from llm.wordhash import _SPACE, batch_hashes, windows

SAMPLE = 256
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL, _UPPER, _LETTER, _LEAD = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_LEAD[:128] = True
_LEAD[192:] = True
_COUNTED = _LEAD & ~_SPACE
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_letters", "n_top_word"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)
N_FEATURES = 8


def repeated_words(win: np.ndarray, n_words: int) -> int:
    """Words that lie in a window which occurs twice or more."""
    order = np.argsort(win, kind="stable")
    s = win[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(win), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def text_counts(texts: list[str | None]) -> list[list[int]]:
    """COUNTS and EXTRA of each text."""
    words, n_words = batch_hashes(texts)
    lines, n_lines = batch_hashes(texts, lines=True)
    win = windows(words, WINDOW)
    out, w, ln = [], 0, 0
    for t, n, m in zip(texts, n_words.tolist(), n_lines.tolist()):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        hist = np.bincount(raw, minlength=256)
        own = np.sort(words[w:w + n])
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if n else np.zeros(1, dtype=np.int64)
        out.append([n, int(hist[_COUNTED].sum()), int(hist[_SYMBOL].sum()), m - len(np.unique(lines[ln:ln + m])),
                    repeated_words(win[w:w + n - WINDOW + 1], n) if n >= WINDOW else 0,
                    m, int(hist[_UPPER].sum()), int(hist[_LETTER & _LEAD].sum()), int(np.diff(edge).max()) if n else 0])
        w, ln = w + n, ln + m
    return out


def _stats(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = text_counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64())] + [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id"] + COUNTS + EXTRA)


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The forest's coordinates: shares and logarithms, so that they do not follow length alone."""
    n = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.stack([
        np.log2(n), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n,
        c["n_upper"] / chars, c["n_letters"] / chars, c["n_top_word"] / n], axis=1)


def mean_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, trees: int, seed: int = 11) -> list[tuple[np.ndarray, ...]]:
    """Trees as (feature, cut, left, right, value): feature -1 is a leaf, value its path length."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(SAMPLE)))
    forest = []
    for _ in range(trees if len(x) else 0):
        root = rng.choice(len(x), size=min(SAMPLE, len(x)), replace=False)
        nodes: list[list[float]] = []

        def grow(rows, depth):
            at = len(nodes)
            nodes.append([-1, 0.0, at, at, depth + mean_path(len(rows))])
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            wide = np.flatnonzero(hi > lo)
            if depth < limit and len(rows) > 1 and len(wide):
                f = int(rng.choice(wide))
                cut = rng.uniform(lo[f], hi[f])
                below = x[rows, f] < cut
                if below.any() and not below.all():
                    nodes[at][:4] = [f, cut, grow(rows[below], depth + 1), grow(rows[~below], depth + 1)]
            return at

        grow(root, 0)
        t = np.array(nodes)
        forest.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
    return forest


def anomaly(forest, x: np.ndarray, fitted: int) -> np.ndarray:
    """Anomaly scores in (0, 1]; higher is easier to isolate."""
    if not forest or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for feature, cut, left, right, value in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            live = f >= 0
            if not live.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] < cut[at]
            at = np.where(live, np.where(go, left[at], right[at]), at)
        total += value[at]
    return np.exp2(-(total / len(forest)) / max(mean_path(min(SAMPLE, fitted)), 1e-9))


def pick_threshold(bins: list[tuple[int, int, int]], n_bins: int, keep_good: float) -> float:
    """(bin, good, bad) counts -> the lowest score that is rejected."""
    good, bad = np.zeros(n_bins + 1), np.zeros(n_bins + 1)
    for b, g, w in bins:
        good[b] += g
        bad[b] += w
    if not good.sum() or not bad.sum():
        return 2.0
    lost = good[::-1].cumsum()[::-1] / good.sum()  # of the good rows, if all from this bin on go
    found = bad[::-1].cumsum()[::-1] / bad.sum()
    allowed = np.flatnonzero(lost <= 1 - keep_good)
    if not len(allowed):
        return 2.0
    gain = found[allowed] - lost[allowed]
    best = int(allowed[np.argmax(gain)])
    return best / n_bins if gain.max() > 0 else 2.0


def verdict(batch_counts: dict[str, np.ndarray], rules: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) of rows of COUNTS and EXTRA."""
    forest, fitted, threshold = rules
    score = anomaly(forest, features(batch_counts), fitted)
    failed = (batch_counts["n_words"] < 10) | (100 * batch_counts["n_repeat_words"] > 20 * batch_counts["n_words"])
    return failed, score, ~failed & (score < threshold)


def fit_rules(docs: DataFrame, labels: DataFrame, trees: int = 100, keep_good: float = 0.99, n_bins: int = 2000,
              id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple]:
    """The statistics of all documents (written to the shared folder) and the fitted rules:
    (forest, rows fitted, threshold)."""
    spark = docs.sparkSession
    ship(spark)
    stats = saved(ids_and_text(docs, id_col, text_col).mapInArrow(_stats, STATS), "stats")
    names = COUNTS + EXTRA
    fitted = hash_sample(stats.select("doc_id", *names), trees * SAMPLE, 23).toPandas()
    x = features({c: fitted[c].to_numpy(dtype=np.float64) for c in names})
    forest = fit_forest(x, trees)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    bins = (_judged(stats, (forest, len(x), 2.0)).where("not base_failed").select("doc_id", F.floor(F.col("score") * n_bins).cast("int").alias("bin")).join(known, "doc_id")
            .groupBy("bin").agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad")).collect())
    return stats, (forest, len(x), float(pick_threshold([tuple(r) for r in bins], n_bins, keep_good)))


def _judged(stats: DataFrame, rules: tuple) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        for b in batches:
            c = {n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in COUNTS + EXTRA}
            failed, score, kept = verdict(c, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(b.schema.get_field_index(n)) for n in COUNTS], pa.array(failed), pa.array(score), pa.array(kept)],
                                             ["doc_id", *COUNTS, "base_failed", "score", "kept"])
    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = 100, keep_good: float = 0.99, n_bins: int = 2000,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, COUNTS, base_failed, score, kept; see the module text.

    ``labels`` has doc_id and quality (1 good, 0 bad; others are not used).
    """
    return _judged(*fit_rules(docs, labels, trees, keep_good, n_bins, id_col, text_col))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. The fitted rules are
    applied to the texts again in place, so no text is shuffled."""
    _, rules = fit_rules(docs, labels, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = np.array(text_counts(part.column(part.schema.get_field_index(text_col)).to_pylist()), dtype=np.float64)
                kept = verdict({n: rows[:, i] for i, n in enumerate(COUNTS + EXTRA)}, shared.value)[2]
                yield part.filter(pa.array(kept))
    return docs.mapInArrow(run, docs.schema)
