"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``length`` consecutive words of one text.  Its minimiser is the least hash among its runs of a few words;
consecutive windows with the same minimiser form a super-k-mer, which travels once, as one packed string of its words,
to the bucket of its minimiser.  All occurrences of a window have the same minimiser, so they meet in one bucket, where
sorting the windows counts them exactly: equal sort keys are confirmed word by word.

Strings that repeat within a task are packed once with the list of their occurrences.  Super-k-mers are counted by
minimiser over all rows first.  The windows of a minimiser that would make a bucket larger than planned are split again
by a longer minimiser (runs of more words).  What is still too many is copied text: such windows become rows, equal ones
are reduced within the tasks before they are shuffled, and their first document is joined back, which AQE splits however
many rows share a window.  These rows travel with a 128-bit digest, and the grouping, by the words themselves, tells
whether a digest stands for one window; should it not, the words are joined.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Words, blobs, fresh_names, materialise, scramble, slices

NO_ID = (1 << 63) - 1
#: Packed bytes that one bucket is planned for, and that a task holds before it writes its buckets out.
BUCKET_BYTES, TASK_BYTES = 6 << 20, 24 << 20
#: Words of the runs of the first and the second minimiser.
RUNS = (3, 8)
#: Hot minimisers of a level at most, by the choice of the threshold; they are sent to the tasks as an array.
MOST_HOT = 4_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def minimisers(codes: np.ndarray, length: int, run: int) -> np.ndarray:
    """The minimiser of each window of ``length`` words: the least hash of its runs of ``run`` words."""
    h = codes[: len(codes) - run + 1].copy()
    for k in range(1, run):
        h = mix(h) + codes[k : len(codes) - run + 1 + k]
    h = mix(h)
    width, done = length - run + 1, 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


@lru_cache(maxsize=1)
def _powers_up_to(bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << bits
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)  # modulo 2^64


def span_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words from ``start`` up to ``stop``; equal spans have equal hashes."""
    up, down = _powers_up_to(max(10, int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[stop] - sums[start]) * down[start]


class Slice(Words):
    """The words of a few texts and their windows."""

    def __init__(self, part: pa.RecordBatch, length: int) -> None:
        super().__init__(blobs(part.column("text")))
        self.ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        self.text_hashes = part.column("text_hash").to_numpy(zero_copy_only=False)
        self.row = self.rows()
        self.word_hashes = self.hashes()
        inside = np.arange(len(self)) + length <= np.repeat(self.stop, self.counts)
        #: First word of each window.
        self.windows = np.flatnonzero(inside)

    def keys(self, length: int, runs: tuple, hot: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window and its level: 0, 1, ... by the minimiser used; the number of levels: as a row."""
        at = self.windows
        keys, level = minimisers(self.word_hashes, length, runs[0])[at], np.zeros(len(at), np.int8)
        for k, crowded in enumerate(hot):
            if not len(crowded):
                break
            there = np.flatnonzero(level == k)
            place = np.minimum(np.searchsorted(crowded, keys[there]), len(crowded) - 1)
            there = there[crowded[place] == keys[there]]
            level[there] = k + 1
            if k + 1 < len(runs) and len(there):
                keys[there] = mix(minimisers(self.word_hashes, length, runs[k + 1])[at[there]] + np.uint64(k + 1))
        return keys, level

    def super_kmers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first window, number of windows) of each run of windows of one text with one key."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, row = self.windows, self.row[self.windows]
        new = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
        first = np.flatnonzero(np.concatenate([[True], new]))
        return first, np.diff(np.append(first, len(keys)))


def _slices(batches: Iterator[pa.RecordBatch], length: int, limit: int = 2 << 20) -> Iterator[Slice]:
    for batch in batches:
        for part in slices(batch, "text", limit):
            found = Slice(part, length)
            if len(found.windows):
                yield found


def _key_counts(batches, length: int, runs: tuple, hot: tuple, least: int) -> Iterator[pa.RecordBatch]:
    """(key, super-k-mers) of the last level that ``hot`` leads to, of this task; those below ``least`` are left out."""
    held: list[np.ndarray] = []
    size, total, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge():
        values = np.concatenate([total, *held])
        weights = np.concatenate([counts, np.ones(len(values) - len(total), np.int64)])
        values, inverse = np.unique(values, return_inverse=True)
        return values, np.bincount(inverse, weights, len(values)).astype(np.int64)

    for part in _slices(batches, length):
        keys, level = part.keys(length, runs, hot)
        first, _ = part.super_kmers(keys)
        held.append(keys[first[level[first] == len(hot)]])
        size += len(held[-1])
        if size > 1 << 20:
            total, counts = merge()
            held, size = [], 0
    total, counts = merge()
    chosen = counts >= least
    yield pa.RecordBatch.from_arrays([pa.array(total[chosen].view(np.int64)), pa.array(counts[chosen])], ["key", "n"])


class _Packer:
    """What one task sends: for each bucket, packed strings and their occurrences."""

    def __init__(self, length: int, buckets: int) -> None:
        self.length, self.buckets, self.size = length, buckets, 0
        self.strings: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.press = zstandard.ZstdCompressor(level=3)

    def add(self, part: Slice, first: np.ndarray, n: np.ndarray, keys: np.ndarray) -> None:
        word = part.windows[first]
        last = word + n + self.length - 2
        a, b, line = part.starts[word], part.starts[last] + part.sizes[last], part.line
        self.strings += [line[x:y] for x, y in zip(a.tolist(), b.tolist())]
        self.size += int((b - a).sum()) + 60 * len(a)
        row = part.row[word]
        self.parts.append(
            (
                (keys % np.uint64(self.buckets)).astype(np.int64),
                span_hashes(part.word_hashes, word, last + 1),
                part.ids[row],
                part.text_hashes[row],
                (word - part.begin[row]).astype(np.int32),
            )
        )

    def take(self) -> pa.RecordBatch:
        """The buckets so far, strings once each; equal hashes are confirmed."""
        numbers, packed, strings = [], [], self.strings
        if strings:
            bucket, h, doc, text_hash, start = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            order = np.lexsort((h, bucket))
            bucket, h = bucket[order], h[order]
            same = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (h[1:] == h[:-1])])
            at = np.flatnonzero(same)
            pairs = zip(order[at].tolist(), order[at - 1].tolist())
            same[at] = np.fromiter((strings[x] == strings[y] for x, y in pairs), bool, len(at))
            head = np.flatnonzero(~same)
            counts = np.diff(np.append(head, len(order))).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[head][1:] != bucket[head][:-1]]))
            doc, text_hash, start = doc[order], text_hash[order], start[order]
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(head)]):
                o, p = head[x], head[y] if y < len(head) else len(order)
                text = b"\n".join([strings[j] for j in order[head[x:y]].tolist()])
                body = struct.pack("<3q", len(text), y - x, p - o) + text
                for array in (counts[x:y], doc[o:p], text_hash[o:p], start[o:p]):
                    body += array.tobytes()
                numbers.append(int(bucket[o]))
                packed.append(self.press.compress(body))
        self.strings, self.parts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "blob"])


def _pack(batches, length: int, runs: tuple, buckets: int, hot: tuple) -> Iterator[pa.RecordBatch]:
    packer = _Packer(length, buckets)
    for part in _slices(batches, length):
        keys, level = part.keys(length, runs, hot)
        first, n = part.super_kmers(keys)
        packed = level[first] < len(runs)
        packer.add(part, first[packed], n[packed], keys[first[packed]])
        if packer.size > TASK_BYTES:
            yield packer.take()
    yield packer.take()


def _unpack(blob: bytes):
    body = zstandard.ZstdDecompressor().decompress(blob)
    size, strings, occurrences = struct.unpack_from("<3q", body)
    at = 24 + size
    counts = np.frombuffer(body, np.int32, strings, at)
    at += 4 * strings
    doc = np.frombuffer(body, np.int64, occurrences, at)
    at += 8 * occurrences
    text_hash = np.frombuffer(body, np.int64, occurrences, at)
    at += 8 * occurrences
    return body[24 : 24 + size], counts, doc, text_hash, np.frombuffer(body, np.int32, occurrences, at)


def first_documents(codes: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each window (its first word's position in ``codes``) the least of ``docs`` among equal windows.

    Windows are sorted by a 64-bit hash and neighbours are compared word by word; should two different windows share a
    hash, the words themselves are sorted.
    """
    scrambled = scramble(codes.astype(np.uint64) + np.uint64(1))
    h = scrambled[: len(codes) - length + 1].copy()
    for k in range(1, length):
        h *= np.uint64(BASE)
        h += scrambled[k : len(codes) - length + 1 + k]
    del scrambled
    h = h[starts]
    order = np.argsort(h)
    s = starts[order]
    h = h[order]
    same = h[1:] == h[:-1]
    del h
    at = np.flatnonzero(same)
    equal = np.ones(len(at), bool)
    for k in range(length):
        equal &= codes[s[at + 1] + k] == codes[s[at] + k]
    if not equal.all():
        order = np.lexsort([codes[starts + k] for k in range(length)])
        s = starts[order]
        same = np.ones(len(s) - 1, bool)
        for k in range(length):
            same &= codes[s[1:] + k] == codes[s[:-1] + k]
    del s
    group = np.concatenate([[True], ~same])
    first = np.minimum.reduceat(docs[order], np.flatnonzero(group))
    result = np.empty(len(starts), np.int64)
    result[order] = first[np.cumsum(group, dtype=np.int32) - 1]
    return result


def _count(packed: list[bytes], length: int) -> pa.Table:
    """All windows of one bucket: runs of windows of a document that also start in an earlier one."""
    texts, of_blob = [], []
    for blob in packed:
        text, *rest = _unpack(blob)
        if text:
            texts.append(text)
            of_blob.append(rest)
    if not texts:
        return _ranges([], [], [], [])
    words = Words(texts := b"\n".join(texts).split(b"\n"))
    del texts
    codes, string_start, ends = words.codes()[0], words.begin, words.stop
    del words
    windows = ends - string_start - length + 1
    counts, doc, text_hash, at = (np.concatenate(x) for x in zip(*of_blob))
    del of_blob
    counts = counts.astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    least = np.minimum.reduceat(doc, firsts)
    begin = np.concatenate([[0], np.cumsum(windows)[:-1]])
    starts = np.arange(int(windows.sum()), dtype=np.int32) + np.repeat((string_start - begin).astype(np.int32), windows)
    first = first_documents(codes, starts, np.repeat(least, windows), length)
    del codes, starts
    # a string matters only if some window of it has an earlier document than some occurrence
    most = np.maximum.reduceat(doc, firsts)
    matter = np.flatnonzero(np.minimum.reduceat(first, begin) < most)
    n = counts[matter]
    occurrence = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]) - firsts[matter], n)
    string = np.repeat(matter, n)
    found = []
    for a in range(0, len(string), 1 << 16):  # occurrences of copied strings may be many
        found.append(_hit_runs(first, begin, windows, string[a : a + (1 << 16)], occurrence[a : a + (1 << 16)], doc))
    if not found:
        return _ranges([], [], [], [])
    o, inner, size = (np.concatenate(x) for x in zip(*found))
    return _ranges(doc[o], text_hash[o], at[o] + inner, size)


def _hit_runs(first, begin, windows, string, occurrence, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, its first window, number of windows) of the runs of windows that have an earlier document."""
    w = windows[string]
    row = np.repeat(np.arange(len(w)), w)
    inner = np.arange(int(w.sum())) - np.repeat(np.concatenate([[0], np.cumsum(w)[:-1]]), w)
    hit = first[begin[string][row] + inner] < doc[occurrence][row]
    row, inner = row[hit], inner[hit]
    if not len(row):
        return row, inner, inner
    head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)]))
    return occurrence[row[head]], inner[head], np.diff(np.append(head, len(row)))


def _ranges(doc, text_hash, start, n) -> pa.Table:
    kinds = {"doc_id": (doc, np.int64), "text_hash": (text_hash, np.int64), "start": (start, np.int32), "n": (n, np.int32)}
    return pa.table({k: pa.array(np.asarray(v, t)) for k, (v, t) in kinds.items()})


RANGES = "doc_id bigint, text_hash bigint, start int, n int"
WINDOWS = "high bigint, low bigint, words binary, doc_id bigint, text_hash bigint, start bigint"


def _hot_windows(batches, length: int, runs: tuple, hot: tuple) -> Iterator[pa.RecordBatch]:
    """A row for each window that no minimiser is left for, with a 128-bit digest of its words."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    for part in _slices(batches, length, 1 << 19):
        _, level = part.keys(length, runs, hot)
        at = part.windows[level == len(runs)]
        a, b = part.starts[at], part.starts[at + length - 1] + part.sizes[at + length - 1]
        windows = [part.line[x:y] for x, y in zip(a.tolist(), b.tolist())]
        digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in windows])
        digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
        row = part.row[at]
        numbers = (digests[:, 0], digests[:, 1], None, part.ids[row], part.text_hashes[row], at - part.begin[row])
        columns = [pa.array(windows, pa.binary()) if x is None else pa.array(np.ascontiguousarray(x)) for x in numbers]
        yield pa.RecordBatch.from_arrays(columns, names)


def _repeated_rows(windows: DataFrame) -> DataFrame:
    """Ranges of single windows, of those that also start in an earlier document."""
    texts = windows.groupBy("high", "low", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    variants = F.count("*").alias("variants")
    first = texts.groupBy("high", "low").agg(variants, F.min("first").alias("first"), F.max("last").alias("last"))
    first = materialise(first, "first-documents")
    keys = ["high", "low"]
    if not first.filter("variants > 1").isEmpty():  # two windows with one digest
        first, keys = materialise(texts, "first-documents"), ["high", "low", "words"]
    else:
        windows = windows.drop("words")
    again = windows.join(first.filter("first < last").select(*keys, "first"), keys).filter("first < doc_id")
    return again.select("doc_id", "text_hash", F.col("start").cast("int"), F.lit(1).alias("n"))


def repeated_windows(
    docs: DataFrame, length: int = 13, runs: tuple = RUNS, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(doc_id, text_hash, start, n): runs of n windows, from word ``start``, that also start in an earlier document.

    ``docs`` has doc_id (not null), text_hash and text.  Windows of copied text may come one by one.
    """
    runs = tuple(min(r, length) for r in runs)
    # of all rows: bytes, for the number of buckets, and super-k-mers by minimiser, for the hot ones
    tasks = max(1, docs.rdd.getNumPartitions())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size * 3  # a super-k-mer repeats length - 1 words
    buckets = max(1, -(-expected // bucket_bytes))
    most = max(bucket_bytes // 200, expected // 100 // MOST_HOT)
    hot: tuple[np.ndarray, ...] = ()
    for _ in runs:
        counted = docs.mapInArrow(
            lambda b, hot=hot: _key_counts(b, length, runs, hot, max(1, most // tasks)), "key bigint, n bigint"
        )
        crowded = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("key")
        found = crowded.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)  # at most MOST_HOT
        hot += (np.sort(found.astype(np.int64).view(np.uint64)),)
        if not len(found):
            break
    packed = docs.mapInArrow(lambda b: _pack(b, length, runs, buckets, hot), "bucket bigint, blob binary")
    ranges = packed.groupBy("bucket").applyInArrow(lambda rows: _count(rows.column("blob").to_pylist(), length), RANGES)
    if len(hot) == len(runs) and len(hot[-1]):
        ranges = ranges.unionAll(_repeated_rows(docs.mapInArrow(lambda b: _hot_windows(b, length, runs, hot), WINDOWS)))
    return ranges


def kept_texts(texts: list[bytes], ranges: list, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each text the words that none of its ranges of windows covers, joined by one space; words, and words kept."""
    words = Words(texts)
    change = np.zeros(len(words) + 1, np.int32)
    for begin, found in zip(words.begin.tolist(), ranges):
        if found:
            start = np.array([r["start"] for r in found], np.int64) + begin
            np.add.at(change, start, 1)
            np.add.at(change, start + np.array([r["n"] for r in found], np.int64) + length - 1, -1)
    kept = np.cumsum(change[:-1]) == 0
    line = np.frombuffer(words.line, np.uint8)[np.repeat(kept, words.sizes + 1)].tobytes()
    sums = np.concatenate([[0], np.cumsum(np.where(kept, words.sizes + 1, 0))])
    a, b = sums[words.begin], sums[words.stop]
    number = np.concatenate([[0], np.cumsum(kept)])
    out = [line[x : max(x, y - 1)] for x, y in zip(a.tolist(), b.tolist())]
    return out, words.counts, number[words.stop] - number[words.begin]


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept"]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            kept, words, left = kept_texts(blobs(part.column("text")), part.column("ranges").to_pylist(), length)
            columns = [part.column("doc_id"), pa.array(words), pa.array(words - left), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)


def with_ranges(docs: DataFrame, name: str, length: int = 13, runs: tuple = RUNS) -> DataFrame:
    """``docs`` with the array column ``name`` (start, n), null where nothing is repeated."""
    id_, hash_ = fresh_names([*docs.columns, name], "id", "text")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    keyed = docs.withColumn(id_, order).withColumn(hash_, F.xxhash64("text"))
    rows = keyed.select(F.col(id_).alias("doc_id"), F.col(hash_).alias("text_hash"), "text")
    ranges = materialise(repeated_windows(rows, length, runs), "repeated-windows").distinct()
    lists = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias(name))
    lists = lists.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), name)
    return keyed.join(lists, [id_, hash_], "left").drop(id_, hash_)


def remove_repeats(docs: DataFrame, length: int = 13, runs: tuple = RUNS) -> DataFrame:
    """Removes each word covered by a window whose words also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed and kept (UTF-8, the kept words joined by one space) for every row.  Words are
    ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input, not on what is left.

    Null and empty texts, and texts of fewer words than a window, lose nothing.  A null doc_id counts as larger than any
    other.  Rows that share a doc_id never remove each other's words.  An empty table gives no rows.  Other columns are
    ignored.  Ties can't arise: only strictly smaller ids count.
    """
    found = with_ranges(docs.select("doc_id", "text"), "ranges", length, runs)
    found = found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "ranges")
    return found.mapInArrow(lambda b: _finish(b, length), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def cut_repeats(docs: DataFrame, length: int = 13, runs: tuple = RUNS) -> DataFrame:
    """``docs`` without the words that ``remove_repeats`` would remove, with all columns.

    A text that loses words becomes its kept words joined by one space, and ``n_chars``, if there is one, its length; any
    other text stays as it is.  Rows of which no word is left go; rows without words from the start stay.
    """
    (ranges_,) = fresh_names(docs.columns, "ranges")
    found = with_ranges(docs, ranges_, length, runs)
    cut = found.filter(F.col(ranges_).isNotNull())
    names, schema = docs.columns, docs.schema

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = part.column(ranges_).to_pylist()
                texts = [t.decode() for t in kept_texts(blobs(part.column("text")), found, length)[0]]
                columns = {n: part.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) for t in texts], part.column("n_chars").type)
                whole = pa.RecordBatch.from_arrays(list(columns.values()), names)
                yield whole.filter(pa.array([bool(t) for t in texts], pa.bool_()))

    return found.filter(F.col(ranges_).isNull()).select(*names).unionAll(cut.mapInArrow(shorten, schema))
