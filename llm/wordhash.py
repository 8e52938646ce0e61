"""Words, lines and shingles of whole texts as 64-bit hashes, computed with numpy inside tasks.

A text is read as UTF-8 bytes. Words are maximal runs of bytes other than space
and 0x09-0x0D, so a word never splits a code point. A word's hash is a polynomial
over random byte codes modulo 2^64 (prefix sums, one pass), mixed afterwards; a
window of ``k`` words hashes the ``k`` word hashes in order. Long texts are read
in slices that end at a word's end, so working memory follows the slice, not the
text; only 8 bytes a word stay.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 18
_RNG = np.random.default_rng(20240601)
_CODE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WINDOW = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, kept for the next call."""
    have = _POW.get("p")
    if have is None or len(have) < n:
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, SLICE + 4096)
        one = np.ones(size, dtype=np.uint64)
        p, q = one.copy(), one.copy()
        p[1:], q[1:] = _BASE, inv
        _POW["p"], _POW["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW["p"][:n], _POW["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of one slice of byte codes."""
    p, q = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * p[: len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _joined(texts: list[str | None]):
    """(raw bytes, text number of each byte range) batches of about SLICE bytes: several
    texts joined by line feeds, or one slice of a long text that ends after a line feed
    or, in a line longer than that, after a space."""
    raws, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if size and size + len(raw) > SLICE:
            yield raws, first
            raws, first, size = [], i, 0
        raws.append(raw)
        size += len(raw) + 1
    if raws:
        yield raws, first


def _cuts(raw: np.ndarray, stop: np.ndarray):
    """(begin, end) slices of about SLICE bytes that end after a byte of ``stop``."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            stops = np.flatnonzero(stop[raw[at:end]])
            if len(stops):
                end = at + int(stops[-1]) + 1
                break
            end = min(n, end + SLICE)
        yield raw[at:end]
        at = end


def _word_edges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flag = np.empty(len(part) + 2, dtype=bool)
    flag[0] = flag[-1] = True
    flag[1:-1] = _SPACE[part]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return edge[::2], edge[1::2]


def _line_edges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    feeds = np.flatnonzero(part == 10)
    starts = np.concatenate([[0], feeds + 1])
    ends = np.concatenate([feeds, [len(part)]])
    inked = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum(~_SPACE[part], out=inked[1:])
    keep = inked[ends] > inked[starts]
    return starts[keep], ends[keep]


_FEED = np.zeros(256, dtype=bool)
_FEED[10] = True


def batch_hashes(texts: list[str | None], lines: bool = False, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words or lines of the texts in order, number of them in each text).

    ``lines``: \n-split lines that hold a word, instead of words. Null and empty
    texts have none. Equal words (lines) have equal hashes, whatever surrounds them.
    """
    edges, stop = (_line_edges, _FEED) if lines else (_word_edges, _SPACE)
    out, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    for raws, first in _joined(texts):
        raw = np.frombuffer(b"\n".join(raws), dtype=np.uint8)
        if len(raws) > 1:
            bounds = np.cumsum([len(r) + 1 for r in raws])
        for part in [raw] if len(raws) > 1 else _cuts(raw, stop):
            if lower:
                part = _LOWER[part]
            starts, ends = edges(part)
            out.append(span_hashes(_CODE[part], starts, ends))
            if len(raws) > 1:
                counts[first:first + len(raws)] = np.diff(np.searchsorted(starts, bounds), prepend=0)
            else:
                counts[first] += len(starts)
    return np.concatenate(out), counts


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order; fewer than k words have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h += words[i:i + n] * _WINDOW[i]
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of the k-word shingles of the A-Z
    lower-cased text; with fewer words the whole sequence is one shingle, without
    words (or null) there is none."""
    words, counts = batch_hashes(texts, lower=True)
    allw = windows(words, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(allw[at:at + n - k + 1])
            out.append(s if n == k else s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(windows(words[at:at + n], n) if n else np.zeros(0, dtype=np.uint64))
        at += n
    return out
