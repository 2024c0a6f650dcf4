"""Exact top-k search by inner product over an impact-ordered index.

Components are quantised to integers.  The index of a block of vectors keeps two posting segments: the components of high
impact (magnitude) and those of low impact; queries are cut in the same way.  Scores are accumulated a segment at a time,
by descending impact.  After the high segments the norms of what is left bound every score; a pair whose bound stays below
the query's k-th best score so far is proven not to belong to the result.  If that leaves few possible members, they are
scored exactly and the low segments are never touched for the rest; if not, all segments are processed.

A task walks its blocks by descending norm and carries each query's k-th best score from block to block, so that later
blocks are skipped whole, or cut down to a few possible members, by what earlier ones have proven.

While the queries are proven small they go to every task and the vectors stay where they are.  Larger sets are cut into
query blocks that meet slices of the vectors by an equi-join on their numbers.  Only a task's best k of each query leave it.

Vectors with components so large that a product of doubles isn't exact are kept apart and scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id bigint, vec_id bigint, score bigint"
PACKED = "dimension int, query_ids binary, query_block binary"
#: Vectors of a block, queries of a block, and queries whose scores are held at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 16384, 128
#: Bytes of queries that may go to every task, and blocks of a slice of the vectors otherwise.
BROADCAST_BYTES, SLICE_BLOCKS = 32 << 20, 32
#: A component has high impact above this share of the block's root mean square.
HIGH = 0.1
#: Share of a block's pairs that may be left as possible members for exact scoring one by one.
FEW = 0.03
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def limit(dimension: int) -> float:
    """Below this magnitude sums of products of two vectors are exact in doubles."""
    return float(1 << (52 - max(1, dimension).bit_length()) // 2)


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(values * scale)


class ImpactIndex:
    """The segments of a block of whole numbers, a row a vector, all below ``limit``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        bound = float(np.abs(self.vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1])
        self.kind = np.float32 if bound < 1 << 24 else np.float64  # in which sums of products are exact
        self.high, self.high_norm, self.low_norm, self.norm = segments(self.vectors, self.kind)
        self.whole = self.vectors.astype(self.kind)
        self.top = float(self.norm.max(initial=0))
        self.pairs = self.scored = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        """(query row, vector row, score) of the ``k`` best of each query that may reach ``floor``, its k-th best so far.

        At least the k best that are not below ``floor`` are among them; ties go to the smaller id.
        """
        queries = queries.astype(np.float64)
        floor = np.full(len(ids), -np.inf) if floor is None else floor
        bound = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, queries.shape[1])
        kind = self.kind if bound < 1 << 24 else np.float64
        high, high_norm, low_norm, norm = segments(queries, kind)
        self.pairs += len(ids) * len(self.ids)
        alive = np.flatnonzero(norm * self.top * 1.0001 + 0.5 >= floor)
        if not len(alive) or not len(self.ids):
            none = np.zeros(0, np.int64)
            return none, none, none
        ids, queries, floor = ids[alive], queries[alive], floor[alive]
        own = ids[:, None] == self.ids[None, :]
        scores = high[alive] @ self.high.astype(kind, copy=False).T
        rest = np.outer(high_norm[alive], self.low_norm) + np.outer(low_norm[alive], self.norm)
        slack = (rest * 1.0001 + 0.5).astype(kind)  # for rounding
        kth = floor
        if not np.isfinite(floor).all() and len(self.ids) > k + 1:
            low = np.where(own, -np.inf, scores - slack)
            kth = np.maximum(kth, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        possible = (scores + slack >= kth[:, None]) & ~own
        q, v = np.nonzero(possible)
        if len(q) <= FEW * possible.size + k * len(ids):
            exact = np.concatenate(
                [
                    np.einsum("ij,ij->i", queries[q[a : a + 65536]], self.vectors[v[a : a + 65536]])
                    for a in range(0, len(q), 65536)
                ]
                or [np.zeros(0)]
            )
            self.scored += len(q)
        else:
            scores = queries.astype(kind) @ self.whole.astype(kind, copy=False).T
            self.scored += scores.size
            kth = floor
            if len(self.ids) > k + 1:
                low = np.where(own, -np.inf, scores)
                kth = np.maximum(kth, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            q, v = np.nonzero((scores >= kth[:, None]) & ~own)
            exact = scores[q, v]
        q, v, exact = best(q, v, exact.astype(np.int64), self.ids[v], len(ids), k)
        return alive[q], v, exact


def segments(values: np.ndarray, kind) -> tuple:
    """The components of high impact, zero elsewhere; the norms of the high, the low and all components of each row."""
    squares = values * values
    cut = HIGH * HIGH * (squares.mean() if squares.size else 0.0)
    high = squares > cut
    part, whole = np.where(high, squares, 0).sum(axis=1), squares.sum(axis=1)
    return np.where(high, values, 0).astype(kind), np.sqrt(part), np.sqrt(np.maximum(whole - part, 0)), np.sqrt(whole)


def best(q, v, score, ids, queries: int, k: int):
    """Of each query, the ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort([ids, -score, q])
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, np.arange(queries))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], v[keep], score[keep]


def exact_scores(queries: np.ndarray, vectors: np.ndarray, scale: int) -> np.ndarray:
    """All scores in whole numbers, for components of any size (raw doubles, not yet quantised)."""
    a, b = quantise(queries, scale), quantise(vectors, scale)
    size = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if size < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T

    def whole(raw, quantised):
        found = np.empty(raw.shape, object)
        for at in np.ndindex(raw.shape):
            found[at] = int(quantised[at]) if np.isfinite(quantised[at]) else int(raw[at]) * scale
        return found

    found = whole(queries, a) @ whole(vectors, b).T
    return np.clip(found, LEAST, MOST).astype(np.int64)


class Walk:
    """The best of each query over the blocks of a task, for queries of one dimension."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int, scale: int) -> None:
        self.k, self.scale, self.raw, self.ids = k, scale, raw, ids
        self.queries = quantise(raw, scale)
        large = (np.abs(self.queries) >= limit(raw.shape[1])).any(axis=1)
        self.small, self.large = np.flatnonzero(~large), np.flatnonzero(large)
        none = np.zeros(0, np.int64)
        self.found = (none, none, none)  # query row, vec_id, score
        self.later: list[tuple] = []

    def _keep(self, q, ids, score) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(self.found, (q, ids, score)))
        self.found = best(q, ids, score, ids, len(self.ids), self.k)

    def floor(self) -> np.ndarray:
        """The k-th best score of each query so far."""
        q, _, score = self.found
        floor = np.full(len(self.ids), -np.inf)
        stop = np.searchsorted(q, np.arange(len(self.ids)), side="right")
        full = stop - np.searchsorted(q, np.arange(len(self.ids))) >= self.k
        floor[full] = score[stop[full] - 1]
        return floor

    def block(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """Searches a block of vectors (raw doubles)."""
        values = quantise(raw, self.scale)
        large = (np.abs(values) >= limit(raw.shape[1])).any(axis=1)
        usual = np.flatnonzero(~large)
        if len(usual) and len(self.small):
            index, floor = ImpactIndex(ids[usual], values[usual]), self.floor()
            for a in range(0, len(self.small), AT_ONCE):
                rows = self.small[a : a + AT_ONCE]
                q, v, score = index.search(self.ids[rows], self.queries[rows], self.k, floor[rows])
                if len(q):
                    self.later.append((rows[q], index.ids[v], score))
            self._flush()
        pairs = [(self.large, usual), (np.arange(len(self.ids)), np.flatnonzero(large))]
        for rows, there in pairs:
            for a in range(0, len(rows) if len(there) else 0, AT_ONCE):
                part = rows[a : a + AT_ONCE]
                scores = exact_scores(self.raw[part], raw[there], self.scale)
                q, v = np.nonzero(self.ids[part][:, None] != ids[there][None, :])
                self._keep(part[q], ids[there][v], scores[q, v])

    def _flush(self) -> None:
        if self.later:
            self._keep(*(np.concatenate(x) for x in zip(*self.later)))
        self.later = []

    def take(self) -> pa.RecordBatch:
        q, ids, score = self.found
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[q]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"]
        )


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each dimension."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    vectors = batch.column("vector")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    start = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield ids[rows], values[start[rows][:, None] + np.arange(size)[None, :]].reshape(len(rows), size)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of about ``rows`` vectors of one dimension."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, values in _by_dimension(batch):
            parts = held.setdefault(values.shape[1], [])
            parts.append((ids, values))
            if sum(len(i) for i, _ in parts) >= rows:
                yield tuple(np.concatenate(x) for x in zip(*held.pop(values.shape[1])))
    for parts in held.values():
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _norm(block) -> float:
    with np.errstate(over="ignore"):
        return -float((block[1] ** 2).sum(axis=1).max(initial=0))


def _in_order(blocks: Iterator, at_once: int) -> Iterator:
    """The blocks, of each so many the one with the largest norm first."""
    held = []
    for block in blocks:
        held.append(block)
        if len(held) == at_once:
            yield from sorted(held, key=_norm)
            held = []
    yield from sorted(held, key=_norm)


def _search_all(batches, packed: list[tuple[int, bytes, bytes]], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    walks: dict[int, list[Walk]] = {}
    for size, ids, values in packed:
        ids = np.frombuffer(ids, np.int64)
        walks.setdefault(size, []).append(Walk(ids, np.frombuffer(values).reshape(len(ids), size), k, scale))
    for ids, values in _in_order(_blocks(batches, BLOCK), SLICE_BLOCKS):
        for walk in walks.get(values.shape[1], []):
            walk.block(ids, values)
    for found in walks.values():
        for walk in found:
            yield walk.take()


def _pack_queries(batches, rows: int) -> Iterator[pa.RecordBatch]:
    for ids, values in _blocks(batches, rows):
        columns = [values.shape[1]], [ids.tobytes()], [np.ascontiguousarray(values, np.float64).tobytes()]
        kinds = pa.int32(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in PACKED.split(", ")])


def _meet(table: pa.Table, k: int, scale: int) -> pa.Table:
    """A slice of the vectors and one query block; vectors and queries come as packed rows."""
    walks, blocks = [], []
    for size, asked, ids, values in zip(*(table.column(c).to_pylist() for c in ("dimension", "asked", "ids", "block"))):
        ids = np.frombuffer(ids, np.int64)
        values = np.frombuffer(values).reshape(len(ids), size)
        if asked:
            walks.append(Walk(ids, values, k, scale))
        else:
            blocks.append((ids, values))
    for ids, values in sorted(blocks, key=_norm):
        for walk in walks:
            walk.block(ids, values)
    batches = [w.take() for w in walks]
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.Table.from_batches(batches, pa.schema([(n, pa.int64()) for n in names]))


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    values = F.col("embedding").cast("array<double>")
    ok = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return rows.select("vec_id", F.col("embedding").alias("vector"))


def search(
    embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The ``k`` best vectors for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    ``embeddings`` has vec_id and embedding (array of numbers).  Score: inner product of the vectors of ``floor(scale * x)``,
    x as double.  All rows are candidates but those with the query's own id; ties go to the smaller vec_id.  A query with
    fewer than k other vectors gets all of them.  Vectors of different dimensions never meet; vectors without components
    score 0 with each other.

    Rows with null vec_id, null vector, or null or non-finite components take no part; finite components of any size do,
    and scores beyond 64 bits become the end of that range.  Repeated rows are candidates each; of rows that share a
    query's id the least vector is the query.  Empty table: no rows.  Other columns are ignored.
    """
    rows = taking_part(embeddings)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = F.sum(8 * F.size("vector") + 16)
    bytes_ = asked.agg(size).first()[0] or 0
    packed = asked.mapInArrow(lambda b: _pack_queries(b, QUERY_BLOCK), PACKED)
    if bytes_ <= broadcast_bytes:
        queries = [tuple(r) for r in packed.collect()]
        sent = embeddings.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1]), bytes(r[2])) for r in queries])
        found = rows.mapInArrow(lambda b: _search_all(b, sent.value, k, scale), RESULT)
    else:
        total = rows.agg(size).first()[0]
        parts = -(-bytes_ // broadcast_bytes)
        slices = -(-total // (broadcast_bytes * 4))
        names = ["dimension", F.col("query_ids").alias("ids"), F.col("query_block").alias("block")]
        blocks = rows.mapInArrow(lambda b: _pack_queries(b, BLOCK), PACKED).select(*names, F.lit(False).alias("asked"))
        asking = packed.select(*names, F.lit(True).alias("asked"))
        zero = F.lit(0).cast("bigint")
        number = F.pmod(F.xxhash64("ids"), F.lit(slices)).alias("slice")
        of = F.pmod(F.xxhash64("ids"), F.lit(parts)).alias("part")
        blocks = blocks.select("*", number, F.explode(F.sequence(zero, F.lit(parts - 1).cast("bigint"))).alias("part"))
        asking = asking.select("*", F.explode(F.sequence(zero, F.lit(slices - 1).cast("bigint"))).alias("slice"), of)
        met = blocks.unionByName(asking).groupBy("part", "slice", "dimension")
        found = met.applyInArrow(lambda table: _meet(table, k, scale), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)
