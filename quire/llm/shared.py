"""Helpers that several training-data operators use: folders, vocabulary paths, word splitting, Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Upper case of the 26 ASCII letters and its lower case, for ``translate``.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: U+0020 and U+0009 to U+000D.  ``bytes.split()`` splits on exactly these.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where driver and executors are one
    process, gets a temporary folder when the setting is absent; elsewhere its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def read_table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file; ``QUIRE_VOCABULARIES`` may name another folder."""
    folder = os.environ.get("QUIRE_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh_names(taken, *labels: str) -> list[str]:
    """Column names made from ``labels`` that none of ``taken`` equals, upper or lower case."""
    known, found = {t.lower() for t in taken}, []
    for label in labels:
        name = f"_{label}"
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        found.append(name)
    return found


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose strings in ``column`` have about ``limit`` bytes in all.

    A single longer string is a run of its own.
    """
    offsets = string_offsets(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def string_offsets(array: pa.Array) -> np.ndarray:
    """The offsets of a string or binary array into its data buffer, as int64."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if len(array) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(array.buffers()[1], kind)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def blobs(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string; null gives empty bytes."""
    if pa.types.is_string(array.type):
        array = array.cast(pa.binary())
    elif pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    return [b"" if x is None else x for x in array.to_pylist()]


def longs(array: pa.Array) -> list[int | None]:
    return array.to_pylist()


def materialise(frame, label: str):
    """Writes a table to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = shared_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_enough(frame, rows: int) -> bool:
    """Whether a table has at most so many rows; counts no more than needed to tell."""
    return frame.limit(rows + 1).count() <= rows


def shuffled(frame):
    """Joins of this table are sort-merge joins, which AQE splits at hot keys.

    Spark guesses sizes from compressed files and doesn't know how many rows Python makes of one, so else it may broadcast
    through the driver what doesn't fit there.
    """
    return frame.hint("merge")


def joined(left, right, on, how: str, broadcast_rows: int = 100_000):
    """Joins with ``right`` broadcast if it is proven to have few rows, else by shuffle, which AQE splits at hot keys."""
    return left.join(F.broadcast(right) if small_enough(right, broadcast_rows) else right, on, how)


_SPACES = bytes(32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
#: Bytes of a word that are hashed as numbers; longer words are hashed one by one.
_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a few texts, one after the other, found without a loop over words."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer((b" ".join(texts) + b" ").translate(_SPACES), np.uint8)
        space = raw == 32
        inner = ~space
        begin = inner.copy()
        begin[1:] &= space[:-1]
        starts = np.flatnonzero(begin)
        last = space
        last[0] = False
        last[1:] &= inner[:-1]  # the space behind each word
        self.sizes = np.flatnonzero(last) - starts
        #: The words, each followed by one space.
        self.line = raw[inner | last].tobytes()
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        #: First word of each text, and the number of words.
        self.stop = np.searchsorted(starts, bounds)
        self.begin = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    @property
    def counts(self) -> np.ndarray:
        return self.stop - self.begin

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.begin), dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes."""
        found = scramble(self.sizes.astype(np.uint64) + np.uint64(1))
        data = self.line + bytes(8)
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # at every byte
        for k in range(0, _LONG, 8):
            left = self.sizes - k
            at = np.flatnonzero((left > 0) & (self.sizes <= _LONG)) if k else np.flatnonzero(self.sizes <= _LONG)
            if not len(at):
                break
            part = eights[self.starts[at] + k] & _MASKS[np.minimum(left[at], 8)]
            found[at] = scramble((found[at] ^ part) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(self.sizes > _LONG).tolist():
            a = int(self.starts[i])
            found[i] = xxhash.xxh64_intdigest(self.line[a : a + int(self.sizes[i])], 9)
        return found

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each word, the same for equal words alone, and how many there are."""
        ends = np.append(self.starts, len(self.line)).astype(np.int64)
        kind = pa.large_binary()
        array = pa.Array.from_buffers(kind, len(self), [None, pa.py_buffer(ends), pa.py_buffer(self.line)])
        found = array.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), len(found.dictionary)
