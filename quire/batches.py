"""Arrow batches in parts, so that a Python worker holds few rows as objects at once, however large the batch is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken in, rows and characters given out at once.
BYTES, ROWS, CHARACTERS = 1 << 20, 2000, 1 << 20


def parts(array: pa.Array, limit: int = BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of strings with about ``limit`` bytes; a longer string is a run of its own."""
    wide = np.int64 if pa.types.is_large_string(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], wide)[array.offset : array.offset + len(array) + 1] if len(array) else [0]
    start = 0
    while start < len(array):
        stop = min(len(array), start + ROWS, max(start + 1, int(np.searchsorted(raw, int(raw[start]) + limit, side="right")) - 1))
        yield start, stop - start
        start = stop


def gathered(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches of few rows and characters."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(out) >= ROWS or size >= CHARACTERS:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
