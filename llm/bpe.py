"""Token ids of whole texts by a byte-level vocabulary file, through a word cache."""

from __future__ import annotations

import re
import struct

#: A byte-level vocabulary cuts a text before every space that a non-space follows,
#: so the parts between such cuts can be encoded one by one.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")
END_OF_TEXT = "<|endoftext|>"


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a tokenizers JSON file of the byte-level kind: its token
    strings write each byte as a printable character, in the order of the byte's rank
    among the printable ones and then the others."""
    import json
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(back[c] for c in t): i for t, i in vocab.items() if t != END_OF_TEXT}


class _Words(dict):
    """Ids of the words seen first, ``room`` of them; the others are encoded each time."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) < self.room:
            self[word] = ids
        return ids


class CachedEncoder:
    """Ids as little-endian uint32 bytes, equal to those of the tokenizers library with
    the same file (add_special_tokens=False); the merges run in tiktoken."""

    def __init__(self, path: str, cache_words: int = 250_000):
        import public_tokenizers
        import tiktoken
        ranks = byte_vocabulary(path)
        self.core = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.words = _Words(self._ids, cache_words)

    def _ids(self, text: str) -> bytes:
        ids = self.core.encode(text, allowed_special="all") if END_OF_TEXT in text else self.core.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ") if _ODD.search(text) is None else _CUT.split(text)
        return self._ids(first) + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
