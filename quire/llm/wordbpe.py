"""Exact and fast encoding with a BPE vocabulary that drops white space and lower-cases.

The vocabulary's pre-tokenizer never joins characters across a space or line feed, and its normaliser (NFC, white
space, lower case) looks at no neighbour across one, so a text's ids are those of its space-separated chunks, one after
the other.  Chunks repeat; a dictionary keeps their ids as packed bytes.  A chunk of Latin-1 characters is lower-cased
and split by an equal pattern, and its words go to the BPE model alone; any other goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import struct

#: Entries after which a dictionary is emptied: bounds a worker's memory, never the result.
LIMIT = 450_000

_simple = re.compile("[\\x21-\\x7eÀ-ÖØ-öø-ÿ]+").fullmatch
_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def byte_characters() -> dict[int, str]:
    """The usual printable stand-in for each byte of byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return table


class _Words(dict):
    def __init__(self, model) -> None:
        self.model = model
        stand_in = byte_characters()
        self.table = str.maketrans({chr(c): "".join(stand_in[b] for b in chr(c).encode()) for c in range(256)})

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.translate(self.table))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= LIMIT:
            self.clear()
        self[word] = packed
        return packed


class _Chunks(dict):
    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.words = _Words(tokenizer.model)
        self.special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            packed = b""
        elif _simple(chunk) and not ("<" in chunk and any(s in chunk for s in self.special)):
            words = self.words
            packed = b"".join([words[w] for w in _words(chunk.lower())])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= LIMIT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class WordBpe:
    """One encoder a Python worker, kept between tasks."""

    _cache: dict[str, WordBpe] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.chunks = _Chunks(Tokenizer.from_file(path))

    @classmethod
    def cached(cls, path: str) -> WordBpe:
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.replace("\n", " ").split(" ")])
