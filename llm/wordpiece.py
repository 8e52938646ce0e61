"""Token counts by greedy longest match, without building the pieces.

Method: linear longest-match automaton. The vocabulary is a trie with two roots, one
for pieces that start a word and one for pieces that continue it. Where no edge goes
on, a failure link leads to the node that the rest of the read letters reach once the
longest pieces in front are popped; the number of popped pieces is stored with the
link, so a word's pieces are counted while its letters are read once.

Words are maximal runs of bytes other than space and 0x09-0x0D of whole texts. Counts of
the words seen first (``CACHE_WORDS`` of them) are kept per worker; other words are read
again each time.

Defined cases: null and empty texts have no words and no tokens; a word that the
vocabulary cannot spell is one unknown token; repeated rows are rows of their own; null
ids are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from llm.common import ids_and_text, ship

CACHE_WORDS = 250_000


class Automaton:
    """``first``: pieces that start a word, ``rest``: pieces that continue one (bytes, not empty)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node; nodes 0 and 1 are the roots
        ends: set[int] = set()
        self.size = 2
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    node = self.edges.get(key)
                    if node is None:
                        node = self.edges[key] = self.size
                        self.size += 1
                if node > 1:
                    ends.add(node)
        children: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]
        for key, node in self.edges.items():
            children[key >> 8].append((key & 255, node))
        self.link = [-1] * self.size  # -1: nothing can be popped
        self.popped = [0] * self.size
        todo = deque((0, 1))
        while todo:
            u = todo.popleft()
            for byte, v in children[u]:
                if v in ends:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and (z << 8 | byte) not in self.edges:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.edges[z << 8 | byte], n
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, -1 if it cannot be spelled."""
        u, n = 0, 0
        edges, link, popped = self.edges, self.link, self.popped
        for byte in word:
            v = edges.get(u << 8 | byte)
            while v is None:
                if link[u] < 0:
                    return -1
                n += popped[u]
                u = link[u]
                v = edges.get(u << 8 | byte)
            u = v
        while u > 1:
            if link[u] < 0:
                return -1
            n += popped[u]
            u = link[u]
        return n


class _Counts(dict):
    """word -> (pieces, unknown)."""

    def __init__(self, automaton: Automaton, mark: bytes):
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        n = n if n >= 0 else 1 << 40 | 1  # unknown words count in the high bits
        if len(self) < CACHE_WORDS:
            self[word] = n
        return n


_READY: dict[str, _Counts] = {}


def byte_level(path: str) -> _Counts:
    """Counts for a byte-level vocabulary file: a word is read with the space before it, so
    pieces with a leading space start a word and the others continue it."""
    if path not in _READY:
        from llm.bpe import byte_vocabulary
        pieces = byte_vocabulary(path)
        _READY[path] = _Counts(Automaton((p for p in pieces if p[:1] == b" "), (p for p in pieces if p[:1] != b" ")), b" ")
    return _READY[path]


def _count(path: str):
    def run(batches):
        get = byte_level(path).__getitem__
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for t in part.column(1).to_pylist():
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    n = sum(map(get, words))
                    rows.append((len(words), n & (1 << 40) - 1, n >> 40))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "n_words", "n_tokens", "n_unknown"])
    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for each row."""
    ship(docs.sparkSession)
    return ids_and_text(docs, id_col, text_col).mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long, n_unknown long")
