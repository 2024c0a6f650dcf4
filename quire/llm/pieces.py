"""SentencePiece encoding and decoding with forward scores shared along prefixes.

A text becomes marked words: spaces turn into marks, and a word starts at a run of marks.  No piece of the vocabulary
crosses into a mark from the left, so a text's ids are those of its words.  Distinct words are sorted, which is the
depth-first order of their trie, and a stack holds the forward state of every prefix of the present word: the next word
pops to the prefix both share and goes on from there.

With a unigram vocabulary the forward state of a prefix is the best sum of piece scores that ends there (Viterbi).  With
a merge vocabulary it is the one piece that can end the prefix's encoding: the longest-standing property that the
encoding of a prefix extended by piece ``p`` is the encoding of the shorter prefix plus ``p`` exactly if the last piece of
the former and ``p`` stay two pieces when merged on their own.  Either way the state depends on the prefix alone.
Characters outside the vocabulary become byte pieces and separate what is left and right of them.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices

MARK = "▁"
#: Distinct words that a worker remembers before it forgets all; longer words aren't remembered.
LIMIT, LONGEST = 700_000, 64
_units = re.compile("▁*[^▁\\n]+|▁+|\\n[^▁\\n]*").findall
DIGESTS = (
    "doc_id bigint, n_chars bigint, n_words bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
)


def words_of(text: str) -> list[str]:
    """The words of a text: without their mark if they have one, with all marks if they have several.

    A line feed, which no piece holds, starts a word without mark.
    """
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    units = _units(MARK + text.replace(" ", MARK))
    return [u[1:] if u[0] == MARK and u[1:2] != MARK else u for u in units]


def marked(word: str) -> str:
    return word if word[:1] in ("\n", MARK) and word else MARK + word


def model_type(path: str) -> int:
    """1 for unigram, 2 for merges: field 3 of the trainer's settings, field 2 of a model file."""
    with open(path, "rb") as file:
        data = file.read()
    return next((v for n, v in _fields(_field(data, 2)) if n == 3), 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of an encoded message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _field(data: bytes, wanted: int) -> bytes:
    return b"".join(v for n, v in _fields(data) if n == wanted)


class Vocabulary:
    """The pieces of a model file and the forward recursion over them; one a Python worker."""

    _cache: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = model.id_to_piece(list(range(size)))
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece crosses words")
        self.ids = {pieces[i]: i for i in plain}
        self.scores = {pieces[i]: model.get_score(i) for i in plain}
        #: Of a character that is no piece: ten below the least score, as in the library.
        self.penalty = min(self.scores.values(), default=0.0) - 10
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.merges = model_type(path) == 2
        self.pairs: dict[str, dict[str, bool]] = {}
        if self.merges:  # a piece that its own characters don't merge to is never made
            self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            ends.setdefault(piece[-2:], {1}).add(len(piece))
        self.ends = {e: tuple(sorted(sizes, reverse=True)) for e, sizes in ends.items()}
        self.raw = [b""] * size
        for i in plain:
            self.raw[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            if i != self.unknown:
                self.raw[i] = bytes([b])
        self.words: dict[str, bytes] = {}

    @classmethod
    def cached(cls, path: str) -> Vocabulary:
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def merged(self, text: str) -> list[str]:
        """The merge encoding of a few characters: the best adjacent pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: str, right: str) -> bool:
        """Whether two pieces side by side remain what they are; remembered."""
        known = self.pairs.setdefault(left, {})
        if len(known) >= LIMIT // 16:
            known.clear()
        known[right] = found = self.merged(left + right) == [left, right]
        return found

    def _merge_forward(self, word: str, done: int, last: list, sizes: list) -> None:
        """Appends the last piece of the encoding of each longer prefix, and its size; piece null: bytes."""
        ids, ends, pairs, alone = self.ids, self.ends, self.pairs, (1,)
        for end in range(done + 1, len(word) + 1):
            if word[end - 1] not in ids:
                last.append(None)
                sizes.append(1)
                continue
            for size in ends.get(word[end - 2 : end], alone) if end > 1 else alone:
                if size > end:
                    continue
                piece = word[end - size : end]
                if piece not in ids:
                    continue
                before = last[end - size]
                if before:
                    fits = pairs[before].get(piece) if before in pairs else None
                    if not (self.stays(before, piece) if fits is None else fits):
                        continue
                last.append(piece)
                sizes.append(size)
                break
            else:
                raise ValueError(f"the vocabulary has no encoding of {word[:end]!r}")

    def _score_forward(self, word: str, done: int, last: list, sizes: list, best: list) -> None:
        """The same for the best sum of scores, which is appended too."""
        ids, scores, ends = self.ids, self.scores, self.ends
        for end in range(done + 1, len(word) + 1):
            found = -math.inf, None, 1
            for size in ends.get(word[end - 2 : end], (1,)) if end > 1 else (1,):  # of equals the longest
                piece = word[end - size : end]
                if size <= end and piece in ids and best[end - size] + scores[piece] > found[0]:
                    found = best[end - size] + scores[piece], piece, size
            if word[end - 1] not in ids and best[end - 1] + self.penalty > found[0]:
                found = best[end - 1] + self.penalty, None, 1
            best.append(found[0])
            last.append(found[1])
            sizes.append(found[2])

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (little-endian, 32 bits) of distinct words, along their trie."""
        found = {}
        last, sizes, best = [""], [0], [0.0]
        previous = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], sizes[shared + 1 :], best[shared + 1 :]
            if self.merges:
                self._merge_forward(word, shared, last, sizes)
            else:
                self._score_forward(word, shared, last, sizes, best)
            previous = word
            found[word] = self._path(word, last, sizes)
        return found

    def _path(self, word: str, last: list, sizes: list) -> bytes:
        ids, end = [], len(word)
        while end:
            piece = last[end]
            if piece is None:
                encoded = [self.bytes[b] for b in word[end - 1].encode()]
                ids += reversed(encoded if self.unknown not in encoded else [self.unknown])
            else:
                ids.append(self.ids[piece])
            end -= sizes[end]
        ids.reverse()
        if self.unknown in ids:  # neighbours become one
            ids = [i for k, i in enumerate(ids) if i != self.unknown or k == 0 or ids[k - 1] != i]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """(number of marked words, packed ids) of each text."""
        known = self.words
        if len(known) > LIMIT:
            known.clear()
        split = list(map(words_of, texts))
        new = set().union(*split).difference(known)
        if new:
            ids = self.learn(map(marked, new))
            learned = {w: ids[marked(w)] for w in new}
            known.update((w, ids) for w, ids in learned.items() if len(w) <= LONGEST)
            if any(len(w) > LONGEST for w in new):
                known = ChainMap(learned, known)
        get = known.__getitem__
        return [(len(words), b"".join(map(get, words))) for words in split]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; the mark in front is taken away.

        Invalid bytes become U+FFFD; the unknown id and ids of control pieces give nothing, ids out of range an error.
        """
        raw = self.raw
        text = b"".join([raw[i] for i in memoryview(packed).cast("I")]).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text), without a shuffle.

    Null text gives null ids and empty text an empty list.  Null and repeated doc_ids are kept row by row.  An empty table
    gives no rows.  Whole texts of any length; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary.cached(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                found = [memoryview(x[1]).cast("I").tolist() for x in model.encode([t or "" for t in texts])]
                ids = [None if t is None else x for t, x in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ``rows`` (doc_id, ids); null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary.cached(vocabulary)
        for batch in batches:
            texts = [
                None if ids is None else model.decode(struct.pack(f"<{len(ids)}I", *ids))
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes every row and returns the digests: see ``DIGESTS``.

    ``ids_crc32`` is of the little-endian unsigned 32-bit ids; ``lossless`` tells whether the decoded text is the text.
    Null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary.cached(vocabulary)
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.string(), pa.bool_()]
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                out = []
                for doc_id, text, (n, ids) in zip(part.column("doc_id").to_pylist(), texts, model.encode(texts)):
                    back = model.decode(ids)
                    digest = hashlib.sha256(back.encode()).hexdigest()
                    out.append((doc_id, len(text), n, len(ids) >> 2, zlib.crc32(ids), digest, back == text))
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
