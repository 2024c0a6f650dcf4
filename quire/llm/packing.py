"""Harmonic packing of token sequences.

A document becomes its token ids followed by an end id.  The capacity C is divided into reciprocal classes: a piece
of size s belongs to the class whose bins hold exactly ``C // s`` pieces.  A document is cut so that its pieces fill
their classes: whole runs of C first, then the largest size ``C // j`` that fits, again and again; a rest whose class
wastes at most ``slack`` tokens a bin stays in one piece.  The sizes fall doubly exponentially, so a document has few
pieces.  Every task fills its own bins, a bin closes when its class's fixed count is reached, and nothing is shuffled.

Bins still open when a task ends are concatenated, class by class, and cut at C; the rest, below C, is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm.shared import slices
from quire.llm.wordbpe import WordBpe

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, sequence_length bigint"
)
#: Bits of a sequence id that number the sequences of one task.
TASK_BITS = 38


@lru_cache(maxsize=1 << 16)
def rest_sizes(rest: int, capacity: int, slack: int) -> tuple[int, ...]:
    """The piece sizes, largest first, for the last ``rest < capacity`` tokens of a document."""
    sizes = []
    while rest:
        if capacity - capacity // rest * rest <= slack:
            sizes.append(rest)
            break
        size = capacity // -(-capacity // rest)
        sizes.append(size)
        rest -= size
    return tuple(sizes)


class Bins:
    """The open bins of one task."""

    def __init__(self, task: int, capacity: int, slack: int) -> None:
        self.capacity, self.slack = capacity, slack
        self.next_id = task << TASK_BITS
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Cuts a document, given as little-endian 32-bit ids, and places its pieces."""
        tokens, capacity = len(ids) >> 2, self.capacity
        start = 0
        while tokens - start >= capacity:
            self.close([(doc_id, start, tokens, ids[4 * start : 4 * (start + capacity)])])
            start += capacity
        for size in rest_sizes(tokens - start, capacity, self.slack):
            fits = capacity // size  # the class
            pieces = self.open.setdefault(fits, [])
            pieces.append((doc_id, start, tokens, ids[4 * start : 4 * (start + size)]))
            if len(pieces) == fits:
                self.close(self.open.pop(fits))
            start += size

    def close(self, pieces: list[tuple]) -> None:
        offset, total = 0, sum(len(p[3]) for p in pieces) >> 2
        for doc_id, start, tokens, ids in pieces:
            length = len(ids) >> 2
            self.rows.append((doc_id, start, length, zlib.crc32(ids), tokens, self.next_id, offset, total))
            offset += length
        self.next_id += 1

    def finish(self) -> None:
        """Closes what is left without padding."""
        left = [p for fits in sorted(self.open) for p in self.open[fits]]
        self.open.clear()
        room, held = self.capacity, []
        total = sum(len(p[3]) for p in left) >> 2
        whole, rest = divmod(total, self.capacity)
        lengths = [self.capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        queue = iter(lengths)
        room = next(queue, 0)
        for doc_id, start, tokens, ids in left:
            while ids:
                part = ids[: 4 * room]
                held.append((doc_id, start, tokens, part))
                start += len(part) >> 2
                room -= len(part) >> 2
                ids = ids[len(part) :]
                if not room:
                    self.close(held)
                    held, room = [], next(queue, 0)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, slack: int = 20) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row a piece: doc_id, start (ids of its document before it), length, ids_crc32 (unsigned, of little-endian
    unsigned 32-bit ids), doc_tokens (with the end id), sequence_id, offset, sequence_length (tokens in use).

    Null text counts as empty, which still has its end id.  Null and repeated doc_ids are kept as they are: each row is
    a document.  An empty table gives no rows.  Other columns are ignored.  Very long texts become many whole
    sequences, so open bins hold at most one partly filled bin per class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId(), capacity, slack)
        encoder = WordBpe.cached(vocabulary)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    bins.add(doc_id, encoder.encode(text) + end if text else end)
                yield bins.take()
        bins.finish()
        yield bins.take()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, PIECES)
