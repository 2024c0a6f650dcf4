"""Exact and near duplicates with the first arrival kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.batches import parts
from quire.storage import materialise

#: Two of these agree in fingerprints that differ in at most two bits.
SEGMENTS = (0, 16, 32, 48)
_tokens = re.compile(r"\w+").findall


def exact_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, n, first): texts that occur more than once.  Folded map-side; no row but the counts moves."""
    hashed = rows.groupBy(F.md5(F.col(text).cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return hashed.filter("n > 1")


def keep_first_exact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash) of the first row of each text: an aggregate instead of a window, so no group is gathered."""
    return rows.groupBy(F.md5(F.col(text).cast("binary")).alias("hash")).agg(F.min(key).alias(key))


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits, each the majority of the hashes of the text's character runs."""
    joined = "".join(_tokens((text or "").lower()))
    grams = [joined[i : i + width] for i in range(max(1, len(joined) - width + 1))]
    hashes = np.frombuffer(b"".join(blake2b(g.encode(), digest_size=8).digest() for g in set(grams)), np.uint64)
    weights = pd.Series(grams).value_counts()
    order = list(dict.fromkeys(set(grams)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    signed = ((2 * bits - 1) * weights.loc[order].to_numpy()[:, None]).sum(axis=0)
    return int(np.packbits(signed > 0, bitorder="little").view("<i8")[0])


#: Hashes of runs of four characters met so far, by their UTF-16 code units as one number.
_known: dict[int, int] = {}
MOST_KNOWN = 1 << 17


def fingerprints_of(texts: list[str | None]) -> list[int | None]:
    """``fingerprint`` of each text, none for none; a run of characters that many texts have is hashed once."""
    joined = ["".join(_tokens(t.lower())) if t is not None else "" for t in texts]
    out: list[int | None] = [None if t is None else 0 for t in texts]
    at, runs = [], []
    for k, j in enumerate(joined):
        if texts[k] is None:
            continue
        units = np.frombuffer(j.encode("utf-16-le"), "<u2").astype(np.uint64)
        if len(j) < 4 or len(units) != len(j):  # characters beyond 16 bits
            out[k] = fingerprint(j)
            continue
        at.append(k)
        runs.append(units[:-3] | units[1:-2] << np.uint64(16) | units[2:-1] << np.uint64(32) | units[3:] << np.uint64(48))
    if not at:
        return out
    found, where = np.unique(np.concatenate(runs), return_inverse=True)
    hashes = _hashes(found)[where].view(np.uint8).reshape(-1, 8)
    end = 0
    for k, run in zip(at, runs):
        start, end = end, end + len(run)
        ones = np.zeros(64, np.int64)
        for low in range(start, end, 255 * 64):  # of 255 rows at most the sum fits a byte
            bits = np.unpackbits(hashes[low : min(end, low + 255 * 64)], axis=1, bitorder="little")
            ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out[k] = int(np.packbits(2 * ones > len(run), bitorder="little").view("<i8")[0])
    return out


def _hashes(runs: np.ndarray) -> np.ndarray:
    if len(_known) > MOST_KNOWN:
        _known.clear()
    numbers = runs.tolist()
    got = [_known.get(r) for r in numbers]
    new = [k for k, h in enumerate(got) if h is None]
    text = runs[new].astype("<u8").tobytes().decode("utf-16-le")
    for n, k in enumerate(new):
        got[k] = int.from_bytes(blake2b(text[4 * n : 4 * n + 4].encode(), digest_size=8).digest(), "little")
        if len(_known) <= MOST_KNOWN:
            _known[numbers[k]] = got[k]
    return np.array(got, "<u8")


@F.arrow_udf(LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in texts:
        for start, n in parts(array, 1 << 18):
            yield pa.array(fingerprints_of(array.slice(start, n).to_pylist()), pa.int64())


def near_keys(values: DataFrame) -> DataFrame:
    """(f, key): six keys of 32 bits and their kind, of each fingerprint; those at most two bits apart share one."""
    part = [F.shiftrightunsigned("f", s).bitwiseAND(0xFFFF) for s in SEGMENTS]
    keys = [F.shiftleft(part[i], 16) + part[j] + F.lit(n << 32) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return values.select("f", F.explode(F.array(*keys)).alias("key"))


def near_pairs(rows: DataFrame, fp: str = "fp", distance: int = 2) -> DataFrame:
    """(a, b): distinct fingerprints at most two bits apart; they agree in two of four segments (pigeonhole)."""
    if distance > len(SEGMENTS) - 2:
        raise ValueError("more bits than the segments can bear")
    keyed = near_keys(rows.select(F.col(fp).alias("f")).distinct())
    a, b = keyed.select(F.col("f").alias("a"), "key"), keyed.select(F.col("f").alias("b"), "key")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def keep_first_near(rows: DataFrame, key: str, text: str, least_length: int = 30, distance: int = 2) -> DataFrame:
    """Rows (key, fp) that stay when each row in order of ``key`` is dropped if it is near one kept before.

    Texts shorter than ``least_length`` are never compared and stay.  The greedy order is resolved in rounds over the pairs
    of fingerprints: what has no undecided earlier neighbour is decided.  This isn't the same as one of each component.
    """
    long = F.length(text) >= least_length
    hashed = materialise(rows.select(key, fingerprints(F.when(long, F.col(text))).alias("fp")), "fingerprints")
    first = hashed.filter("fp is not null").groupBy("fp").agg(F.min(key).alias("k"))
    pairs = near_pairs(first, "fp", distance)
    at = first.select(F.col("fp").alias("f"), "k")
    edges = pairs.join(at.withColumnsRenamed({"f": "a", "k": "ka"}), "a").join(at.withColumnsRenamed({"f": "b", "k": "kb"}), "b")
    early = F.when(F.col("ka") < F.col("kb"), F.struct(F.col("ka").alias("u"), F.col("kb").alias("v"))).otherwise(
        F.struct(F.col("kb").alias("u"), F.col("ka").alias("v"))
    )
    edges = materialise(edges.select(early.alias("e")).select("e.u", "e.v"), "edges")  # u comes before v
    dropped = None
    while not edges.isEmpty():
        waiting = edges.select(F.col("v").alias("u")).distinct()
        kept = edges.select("u").distinct().join(waiting, "u", "left_anti")
        lost = edges.join(kept, "u", "left_semi").select("v").distinct()
        lost = materialise(lost, "dropped")
        dropped = lost if dropped is None else dropped.unionAll(lost)
        rest = edges.join(kept, "u", "left_anti")
        rest = rest.join(lost, "v", "left_anti").join(lost.select(F.col("v").alias("u")), "u", "left_anti")
        edges = materialise(rest.select("u", "v"), "edges")
    stay = first if dropped is None else first.join(dropped.select(F.col("v").alias("k")), "k", "left_anti")
    return stay.select(F.col("k").alias(key), "fp").unionAll(hashed.filter("fp is null").select(key, "fp"))
