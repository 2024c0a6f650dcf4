"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into three segments of 22, 21 and 21 bits.  Two fingerprints that differ in at
most two bits agree wholly in one segment and differ in at most one bit in another (pigeonhole).  Each segment, as a
23-bit word, is decoded by the perfect binary Golay code [23, 12, 7] to the indices of all codewords within distance 4
(one or six); words that differ in at most one bit always share one, as the codeword within 3 of the first is within 4
of the second.  A key is an ordered pair of segments: the exact value of one and a codeword index of another.  Equal
keys are joined and pairs verified, so no link is lost and keys have 33 or 34 bits.

Equal fingerprints form a class first, so copies never become pairs.  A key that very many classes share is refined by
thirds of the remaining segment: as the remaining segment differs in at most two bits, one third of it agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import blobs, fresh_names, joined, materialise, shuffled, slices

SEED = 42
SHIFTS, WIDTHS = (0, 22, 43), (22, 21, 21)
GENERATOR = 0xC75
ORDERED = tuple((i, j) for i in range(3) for j in range(3) if i != j)
NO_PATTERN = 1 << 30
#: Shingles whose bits are held at once.
AT_ONCE = 255 * 128


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text in UTF-8; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and exactly U+0020 and U+0009 to U+000D separate
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined_words, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    del words
    starts = np.concatenate([[0], ends[:-shingle]])
    stops = ends[shingle - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), AT_ONCE):
        spans = zip(starts[k : k + AT_ONCE].tolist(), stops[k : k + AT_ONCE].tolist())
        counts += bit_counts(np.array([digest(joined_words[a:b], SEED) for a, b in spans], np.uint64))
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255
    total = bits[whole * 255 :].sum(axis=0, dtype=np.int64)
    if whole:  # blocks of 255 are added as bytes
        blocks = np.add.reduce(bits[: whole * 255].reshape(whole, 255, 64), axis=1, dtype=np.uint8)
        total = total + blocks.sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            values = np.fromiter(map(fingerprint, blobs(part.column("text"))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(values.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the whole text), fp (signed) for every row, without a shuffle."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text")
    )
    return rows.mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint")


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and for each syndrome its error patterns of weight 4 or less."""

    def syndrome(word: int) -> int:
        for b in range(22, 10, -1):
            if word >> b & 1:
                word ^= GENERATOR << (b - 11)
        return word

    single = [syndrome(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for table, first, bits in ((low, 0, 12), (high, 12, 11)):
        for b in range(bits):
            table[1 << b : 2 << b] = table[: 1 << b] ^ single[first + b]
    patterns = np.full((2048, 6), NO_PATTERN, np.int32)
    filled = np.zeros(2048, int)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            patterns[s, filled[s]] = sum(1 << b for b in bits)
            filled[s] += 1
    return low, high, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """A row a 23-bit word: the 12-bit indices of the codewords within distance 4; -1 where there are fewer than six."""
    low, high, patterns = golay_tables()
    words = words.astype(np.int32)
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors == NO_PATTERN, -1, (words[:, None] ^ errors) >> 11)


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position of the fingerprint, remaining segment) for all keys of all fingerprints (uint64)."""
    segments = [(values >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS)]
    near = [codeword_indices(s) for s in segments]
    keys, at, rest = [], [], []
    for code, (i, j) in enumerate(ORDERED):
        row, column = np.nonzero(near[j] >= 0)
        keys.append((code << 34) | (segments[i][row].astype(np.int64) << 12) | near[j][row, column])
        at.append(row)
        rest.append(segments[3 - i - j][row].astype(np.int32))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(rest)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        key, at, rest = keys_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(fp[at]), pa.array(rest)], ["key", "fp", "rest"]
        )


def links(classes: DataFrame, most_bits: int = 2, crowded: int = 2000) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) that differ in at most two bits."""
    if not 0 <= most_bits <= 2:
        raise ValueError("the keys are built for at most two differing bits")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a class has 30 keys or more
    keys = classes.select("fp").repartition(tasks, "fp").mapInArrow(_keys, "key bigint, fp bigint, rest int")
    hot = materialise(keys.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded-keys")
    if hot.isEmpty():
        keys = keys.select("key", "fp", F.lit(-1).alias("third"))
    else:
        marked = joined(keys, hot.withColumn("hot", F.lit(True)), "key", "left")
        third = [F.lit(t << 8).bitwiseOR(F.shiftright("rest", s).bitwiseAND(255)) for t, s in enumerate((0, 8, 16))]
        keys = marked.select(
            "key", "fp", F.explode(F.when(F.col("hot"), F.array(*third)).otherwise(F.array(F.lit(-1)))).alias("third")
        )
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(
        shuffled(b),
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.third") == F.col("b.third"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most_bits),
    )
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, most_bits: int = 2) -> DataFrame:
    """For every row of ``docs``: doc_id, text_hash, fp, n_near, root (least fingerprint reachable), component_id.

    Two rows are linked if their fingerprints differ in at most two bits.  n_near counts the other rows linked
    directly, copies and repeated rows included; component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and are linked like any other.  A null doc_id takes part; component_id
    is null only if no row reachable has a doc_id.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    pairs = materialise(links(classes, most_bits), "links")
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionAll(pairs.select("b", "a"))
    sizes = shuffled(classes.select(F.col("fp").alias("other"), "n"))
    near = both.join(sizes, "other").groupBy("fp").agg(F.sum("n").alias("near"))
    known = classes.join(shuffled(near), "fp", "left").join(shuffled(roots), "fp", "left")
    known = materialise(
        known.select(
            "fp",
            (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"),
            F.coalesce("root", "fp").alias("root"),
            "first",
        ),
        "classes",
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(shuffled(known.drop("first").join(shuffled(least), "root")), "fp").select(
        "doc_id", "text_hash", "fp", "n_near", "root", "component_id"
    )


def drop_near_duplicates(docs: DataFrame, most_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id, repeated rows once.

    All columns are kept.  Of rows that share this doc_id, one stays; a null doc_id comes last.
    """
    found = near_duplicates(docs, most_bits)
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = F.min_by(F.struct("doc_id", "text_hash", "n"), F.struct(order, F.col("text_hash")))
    kept = rows.groupBy("root").agg(least.alias("k"))
    text_, doc_, hash_ = fresh_names(docs.columns, "text", "doc", "hash")
    kept = kept.select(F.col("k.doc_id").alias(doc_), F.col("k.text_hash").alias(hash_), F.col("k.n").alias("n"))
    kept = materialise(kept, "kept-documents")
    marked = docs.withColumn(text_, F.xxhash64("text"))
    same = F.col(doc_).eqNullSafe(marked["doc_id"].cast("bigint")) & (F.col(hash_) == F.col(text_))
    stay = marked.join(shuffled(kept.filter("n = 1")), same, "left_semi")
    again = kept.filter("n > 1")  # only repeated rows are grouped
    if not again.isEmpty():
        stay = stay.unionAll(marked.join(shuffled(again), same, "left_semi").dropDuplicates(["doc_id", text_]))
    return stay.drop(text_)
