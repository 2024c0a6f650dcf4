"""Language-model scoring by Ziv-Merhav cross-parsing.

A document is factored greedily, from left to right, into the longest runs of words that occur somewhere in a reference
text; a word that the reference lacks is a run of its own.  With ``c`` runs over ``n`` words and a reference of ``N``
words, ``c log2(N) / n`` estimates the bits a word that a model of the reference spends on the document (its
cross-entropy); taking away the document's own rate ``c' log2(c') / n``, where ``c'`` counts the phrases of its
incremental parsing, leaves the relative entropy.  Both are divided by the document's length, so long and short documents
compare.

``score_against`` takes a reference of bounded size; its longest matches come from a suffix automaton in every worker.

``score`` takes references of any size, rows of the table itself: a row is parsed against all other rows that are in the
reference.  One automaton can't hold them, and automata of its parts would each have to meet every document.  The longest
match at each word is therefore found for all documents at once, in rounds that each ask, for the words that it may still
concern, whether the run of so many words that starts there occurs in another row.  Lengths are 2, 3, 4 and then doubled
as long as runs are met; a run can only be met if its own runs of the length before are, and a match that is longer than 4
words ends where runs of 4 are no longer met, which leaves few words to ask for.  The lengths in between are settled from
the largest power of two down.

Runs travel as 64-bit hashes, once a chunk of documents, to a part picked by the hash, where asking and supplying rows
meet; both learn about it, so only runs that some row shares go on.  Different runs count as equal if their hashes clash,
which for ``a`` runs asked and ``s`` supplied in a round has a chance of about ``a s / 2^64``.  Chunks and their states are
tables bucketed by chunk, which stay where they are between rounds.  Longer runs consist of runs of 4 that were met or
wanted, so after these only the words of such runs are kept for the rounds that follow.
"""

from __future__ import annotations

import gc
import math
import os
import pickle
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Words, blobs, scramble, shared_path, slices

SCORES = (
    "doc_id bigint, n_words bigint, n_phrases bigint, own_phrases bigint, reference_words bigint, cross_bits double, "
    "score double"
)
CHUNKS = "chunk bigint, packed binary, keys array<bigint>, others array<bigint>, good array<boolean>, counts array<bigint>"
#: ``reach`` bounds the runs that a chunk may still ask for or supply.
STATES = "chunk bigint, state binary, active bigint, reach bigint"
#: What is left of a chunk after runs of LONG; ``base`` has the lengths before that, and which words are left.
SMALLER = "chunk bigint, packed binary, base binary, state binary, active bigint, reach bigint"
SENT = "part bigint, chunk bigint, runs binary"
ANSWERS = "receiver bigint, part bigint, answer binary"
#: Text bytes of one chunk of documents, and of the chunks whose runs one part is planned for.
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
#: Text bytes of a reference that every worker may hold as an automaton.
MOST_REFERENCE = 8 << 20
#: Hashes of a part that are met at once, about.
AT_ONCE = 1 << 18
#: From this length on runs are doubled.
LONG = 4
UNBOUNDED = 1 << 62
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def suffix_automaton(words: Iterable) -> list[dict]:
    """The moves of each state; state 0 is the start.  Every path from it spells a run of ``words``."""
    moves: list[dict] = [{}]
    links, lengths, last = [-1], [0], 0
    for word in words:
        state = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = state
            p = links[p]
        if p >= 0:
            q = moves[p][word]
            if lengths[q] == lengths[p] + 1:
                links[state] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = clone
                    p = links[p]
                links[q] = links[state] = clone
        last = state
    return moves


def cross_phrases(moves: list[dict], words: list) -> int:
    """How many greedy longest matches cover ``words``."""
    start = row = moves[0]
    phrases = 0
    for word in words:
        to = row.get(word)
        if to is None:
            if row is not start:
                phrases += 1
                to = start.get(word)
            if to is None:
                phrases += 1
                row = start
                continue
        row = moves[to]
    return phrases + (row is not start)


def own_phrases(words: list) -> int:
    """Phrases of the incremental parsing, each the shortest that hasn't been one yet (the last may have been)."""
    start = row = {}
    phrases = 0
    for word in words:
        to = row.get(word)
        if to is None:
            row[word] = {}
            phrases += 1
            row = start
        else:
            row = to
    return phrases + (row is not start)


def rates(n: int, crossed: int, own: int, reference_words: int) -> tuple:
    """(n_words, n_phrases, own_phrases, reference_words, cross_bits, score)."""
    if not n:
        return 0, 0, 0, reference_words, None, None
    bits = crossed * math.log2(max(2, reference_words)) / n
    return n, crossed, own, reference_words, bits, bits - own * math.log2(own) / n


def _pressed(*values) -> bytes:
    return zstandard.compress(pickle.dumps(values, 5), 1)


def _plain(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _halves(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 2^31 as their low and their high halves, which compress better."""
    return x.astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes()


def _numbers(halves: tuple[bytes, bytes]) -> np.ndarray:
    low, high = (np.frombuffer(h, "<u2") for h in halves)
    return low.astype(np.int32) | (high.astype(np.int32) << 16)


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows: ids, words and own phrases of each, hashes of the distinct words, and the words as their numbers."""
    for batch in batches:
        for part in slices(batch, "text", limit):
            words = Words(blobs(part.column("text")))
            codes, distinct = words.codes()
            hashes = np.zeros(distinct, np.uint64)
            hashes[codes] = words.hashes()
            listed, counts = codes.tolist(), words.counts
            own = [own_phrases(listed[a:b]) for a, b in zip(words.begin.tolist(), words.stop.tolist())]
            ids = part.column("doc_id").to_pylist()
            row = {
                "chunk": int.from_bytes(os.urandom(8), "big", signed=True),
                "packed": _pressed(ids, counts, own, hashes, _halves(codes)),
                "keys": part.column("key").to_pylist(),
                "others": part.column("other").to_pylist(),
                "good": part.column("of_reference").to_pylist(),
                "counts": counts.tolist(),
            }
            kinds = [pa.int64(), pa.binary(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, BASE, np.uint64), np.full(1 << bits, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)  # modulo 2^64


def _tighter(bounds: np.ndarray, flags: np.ndarray, size: int) -> np.ndarray:
    """Bounds after runs of ``size``: who isn't flagged has none, and longest runs end no earlier than those of the word before."""
    at = np.arange(len(bounds), dtype=np.int32)
    most = np.where(bounds > 0, np.where(flags, bounds, np.minimum(bounds, size - 1)), LONG - 1)
    ends = np.minimum.accumulate((at + most)[::-1])[::-1]
    return np.where(bounds > 0, ends - at, 0).astype(np.int32)


def _implied(lengths: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Lengths that follow from the words before, as longest runs end no earlier; ``asked`` has the bounds of who asks."""
    at = np.arange(len(lengths), dtype=np.int32)
    return np.maximum.accumulate(at + np.where(asked > 0, lengths, 0)) - at


def _stretch(flags: np.ndarray) -> np.ndarray:
    """How many flags in a row are set from each place on."""
    n = len(flags)
    stop = np.where(flags, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


class State:
    """What is known of a chunk: per row whether it asks and supplies; per word the longest run known to be met, whether the
    last runs asked for were met and wanted, and bounds for longer ones; the runs (place, size) that are supplied later on."""

    def __init__(self, data: bytes) -> None:
        self.asks, self.supplies, lengths, met, wanted, bounds, places, sizes = _plain(data)
        self.lengths = _numbers(lengths)
        n = len(self.lengths)
        self.met, self.wanted = (np.unpackbits(x, count=n).astype(bool) for x in (met, wanted))
        self.bounds = []
        for at, values in bounds:  # zero elsewhere
            self.bounds.append(np.zeros(n, np.int32))
            self.bounds[-1][_numbers(at)] = _numbers(values)
        self.places, self.sizes = _numbers(places), _numbers(sizes)

    @staticmethod
    def packed(asks, supplies, lengths, met, wanted, bounds, places, sizes) -> bytes:
        sparse = []
        for x in bounds:
            at = np.flatnonzero(x)
            sparse.append((_halves(at), _halves(x[at])))
        bits = np.packbits(met), np.packbits(wanted)
        return _pressed(asks, supplies, _halves(lengths), *bits, sparse, _halves(places), _halves(sizes))

    def bytes(self) -> bytes:
        kept = self.lengths, self.met, self.wanted, self.bounds, self.places, self.sizes
        return State.packed(self.asks, self.supplies, *kept)


def _smaller(static: bytes, state: bytes) -> tuple[bytes, bytes, bytes]:
    """After runs of LONG: the chunk with only the words of runs that were met or wanted, its base, and its state.

    No longer run has other words, and those it has stay next to each other.
    """
    known = State(state)
    _, counts, _, hashes, codes = _plain(static)
    begun = known.met | known.wanted
    keep = begun.copy()
    for k in range(1, LONG):
        keep[k:] |= begun[:-k]
    stops = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(keep)])
    distinct, codes = np.unique(_numbers(codes)[keep], return_inverse=True)
    packed = _pressed(None, total[stops] - total[stops - counts], None, hashes[distinct], _halves(codes))
    base = _pressed(_halves(known.lengths), np.packbits(keep))
    kept = known.lengths[keep], known.met[keep], known.wanted[keep], [b[keep] for b in known.bounds]
    return packed, base, State.packed(known.asks, known.supplies, *kept, total[known.places], known.sizes)


def _whole_lengths(base: bytes | None, state: bytes) -> np.ndarray:
    """The lengths of all words of a chunk."""
    known = State(state)
    found = known.lengths
    if base is None:
        return found
    found = np.where(known.bounds[0] > 0, np.maximum(found, _implied(found, known.bounds[0])), found)
    lengths, keep = _plain(base)
    whole = _numbers(lengths)
    whole[np.unpackbits(keep, count=len(whole)).astype(bool)] = found
    return whole


class Round:
    """The runs that a chunk asks for and supplies in a round, as sorted distinct hashes.

    Rounds are ("rise", length, length before), ("census", 0, 0), which asks who waits at the runs that are supplied, and
    ("fall", step, 0).
    """

    def __init__(self, static: bytes, state: bytes, kind: str, size: int, before: int) -> None:
        self.kind, self.size = kind, size
        self.state = known = State(state)
        _, counts, _, hashes, codes = _plain(static)
        n = len(known.lengths)
        self.row = row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        at = np.arange(n, dtype=np.int32)
        self.left = left = np.repeat(np.cumsum(counts).astype(np.int32), counts) - at  # words from here to the end
        if kind == "rise":
            on = left >= size
            if before:
                shifted = np.minimum(at + (size - before), n - 1)
            met, wanted = known.asks[row] & on, known.supplies[row] & on
            if before:
                met &= known.met & known.met[shifted]
                wanted &= known.wanted & known.wanted[shifted]
            if known.bounds:
                met &= known.bounds[0] >= size
                wanted &= known.bounds[1] >= size
            self.asked, self.places = np.flatnonzero(met), np.flatnonzero(wanted)
            self.old = None
        elif not known.bounds:
            self.asked = self.places = self.asked_sizes = self.sizes = self.old = np.zeros(0, np.int64)
        else:
            waits = known.asks[row] & (known.lengths >= max(LONG, 2 * size)) & (known.lengths < known.bounds[0])
            waits &= known.lengths + size <= known.bounds[0]
            waits &= _implied(known.lengths, known.bounds[0]) < known.bounds[0]
            self.asked = np.flatnonzero(waits)
            self.asked_sizes = known.lengths[self.asked].astype(np.int64) + size
            on = (known.sizes >= 2 * size) & (known.sizes + max(size, 1) <= known.bounds[1][known.places])
            self.old = np.flatnonzero(on)
            self.places = known.places[self.old].astype(np.int64)
            self.sizes = known.sizes[self.old].astype(np.int64) + size
        if not len(self.asked) and not len(self.places):
            self.hashes = np.zeros(0, np.uint64)
            self.of_asked = self.of_places = np.zeros(0, np.int64)
            return
        up, down = _powers(max(12, int(n).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes[_numbers(codes)] * up[:n], out=sums[1:])

        def runs(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return scramble((sums[at + sizes] - sums[at]) * down[at] + sizes.astype(np.uint64) * np.uint64(BASE))

        if kind == "rise":  # many places both ask and supply
            both = np.flatnonzero(met | wanted)
            self.hashes, place = np.unique(runs(both, np.array([size])), return_inverse=True)
            of = np.zeros(n, np.int64)
            of[both] = place
            self.of_asked, self.of_places = of[self.asked], of[self.places]
        else:
            sent = [runs(self.asked, self.asked_sizes), runs(self.places, self.sizes)]
            self.hashes, place = np.unique(np.concatenate(sent), return_inverse=True)
            self.of_asked, self.of_places = place[: len(self.asked)], place[len(self.asked) :]

        self.asking, self.asking_row = self._rows(self.of_asked, self.asked)
        order = np.arange(len(self.places)) if self.old is None else np.argsort(self.places, kind="stable")
        self.supplying, self.supplying_row = self._rows(self.of_places[order], self.places[order])

    def _rows(self, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows, two at most, are behind each hash, and the first; places ascend."""
        least = np.full(len(self.hashes), -1, np.int32)
        most = np.full(len(self.hashes), -1, np.int32)
        rows = self.row[at]
        least[of[::-1]] = rows[::-1]
        most[of] = rows
        return ((most >= 0) * 1 + (most > least)).astype(np.uint8), least

    def flags(self) -> np.ndarray:
        """Rows that ask, and four times the rows that supply."""
        return self.asking + 4 * self.supplying

    def learn(self, answer: np.ndarray) -> tuple[bytes, int]:
        """The state after the round, and how many words have something left to ask; ``answer`` is like ``flags``, of all chunks."""
        known, row = self.state, self.row
        askers, suppliers = answer & 3, answer >> 2
        if not len(self.hashes):
            self.asking_row = self.supplying_row = np.zeros(0, np.int32)
        # of one row alone: it must be another one
        theirs, others = suppliers[self.of_asked], self.supplying_row[self.of_asked] != row[self.asked]
        met = (theirs > 1) | ((theirs == 1) & others)
        theirs, others = askers[self.of_places], self.asking_row[self.of_places] != row[self.places]
        wanted = (theirs > 1) | ((theirs == 1) & others)
        if self.kind == "rise":
            known.met, known.wanted = np.zeros(len(row), bool), np.zeros(len(row), bool)
            known.met[self.asked[met]] = True
            known.wanted[self.places[wanted]] = True
            known.lengths[known.met] = self.size
            if self.size == LONG:
                known.bounds = []
                for flags in (known.met, known.wanted):
                    reach = np.minimum(_stretch(flags) + LONG - 1, self.left)
                    known.bounds.append(np.where(flags, reach, 0).astype(np.int32))
            elif self.size > LONG and len(row):
                flagged = zip(known.bounds, (known.met, known.wanted))
                known.bounds = [_tighter(b, flags, self.size) for b, flags in flagged]
            if self.size >= LONG:
                new = self.places[wanted]
                known.places = np.concatenate([known.places, new.astype(np.int32)])
                known.sizes = np.concatenate([known.sizes, np.full(len(new), self.size, np.int32)])
            return known.bytes(), int(met.sum())
        if self.kind == "census":
            keep = self.old[wanted]
            known.places, known.sizes = known.places[keep], known.sizes[keep]
            return known.bytes(), int(met.sum())
        known.lengths[self.asked[met]] += self.size
        if known.bounds and len(row):
            known.bounds[0][self.asked[~met]] = self.asked_sizes[~met] - 1
            known.bounds[0] = _tighter(known.bounds[0], np.ones(len(row), bool), 0)
        known.places = np.concatenate([known.places, self.places[wanted].astype(np.int32)])
        known.sizes = np.concatenate([known.sizes, self.sizes[wanted].astype(np.int32)])
        keep = (known.sizes < known.bounds[1][known.places]) & (self.size > 1) if known.bounds else slice(None)
        known.places, known.sizes = known.places[keep], known.sizes[keep]
        return known.bytes(), int(met.sum())


def _coded(hashes: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted hashes as steps of as many bytes as the largest needs, and a byte of flags each."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    size = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    first = int(hashes[0]).to_bytes(8, "little")
    body = steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    return bytes([size]) + first + len(hashes).to_bytes(4, "little") + body + zstandard.compress(flags.tobytes(), 1)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, first, n = data[0], int.from_bytes(data[1:9], "little"), int.from_bytes(data[9:13], "little")
    steps = np.zeros((n, 8), np.uint8)
    steps[1:, :size] = np.frombuffer(data, np.uint8, (n - 1) * size, 13).reshape(-1, size)
    steps = steps.view("<u8").ravel()
    steps[0] = first
    flags = np.frombuffer(zstandard.decompress(data[13 + (n - 1) * size :]), np.uint8)
    return np.cumsum(steps, dtype=np.uint64), flags


def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Values of one row at a time, as chunks are large."""
    columns = [batch.column(c) for c in names]
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in columns)


def _send(batches: Iterator[pa.RecordBatch], what: tuple, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, static, state in _rows_of(batch, "chunk", "packed", "state"):
            runs = Round(static, state, *what)
            if not len(runs.hashes):
                continue
            flags = runs.flags()
            part = ((runs.hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the hash
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
            blob = [_coded(runs.hashes[a:b], flags[a:b]) for a, b in zip(cuts, cuts[1:])]
            numbers = part[cuts[:-1]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array([chunk] * len(blob), pa.int64()), pa.array(blob, pa.binary())],
                ["part", "chunk", "runs"],
            )


def _answer(table: pa.Table) -> pa.Table:
    """For each run sent to this part, the rows of all chunks that ask and supply, two at most each.

    Hashes are sorted within a chunk, so a range of them at a time is met, which bounds what is held.
    """
    chunks, sent = table.column("chunk"), [_decoded(x) for x in table.column("runs").to_pylist()]
    ranges = -(-sum(len(h) for h, _ in sent) // AT_ONCE)
    low, high = min(int(h[0]) for h, _ in sent), max(int(h[-1]) for h, _ in sent)
    bounds = np.array([low + (high - low) * k // ranges for k in range(1, ranges)], np.uint64)
    edges = [[0, *np.searchsorted(h, bounds).tolist(), len(h)] for h, _ in sent]
    answers = [np.empty(len(h), np.uint8) for h, _ in sent]
    for k in range(ranges):
        found, at = np.unique(np.concatenate([h[e[k] : e[k + 1]] for (h, _), e in zip(sent, edges)]), return_inverse=True)
        flags = np.concatenate([f[e[k] : e[k + 1]] for (_, f), e in zip(sent, edges)])
        asking = np.minimum(np.bincount(at, flags & 3, len(found)), 2).astype(np.uint8)
        supplying = np.minimum(np.bincount(at, flags >> 2, len(found)), 2).astype(np.uint8)
        answer, start = (asking + 4 * supplying)[at], 0
        for whole, e in zip(answers, edges):
            n = e[k + 1] - e[k]
            whole[e[k] : e[k + 1]] = answer[start : start + n]
            start += n
    parts = [zstandard.compress(x.tobytes(), 1) for x in answers]
    return pa.table({"receiver": chunks, "part": table.column("part"), "answer": pa.array(parts, pa.binary())})


def _learn(known: pa.Table, answers: pa.Table, what: tuple) -> pa.Table:
    chunk, static, state = (known.column(c)[0].as_py() for c in ("chunk", "packed", "state"))
    reach, active = known.column("reach")[0].as_py(), 0
    if answers.num_rows or reach == UNBOUNDED:  # else nothing was asked
        runs = Round(static, state, *what)
        order = np.argsort(answers.column("part").to_numpy())
        parts = answers.column("answer").to_pylist()
        answer = np.frombuffer(b"".join(zstandard.decompress(parts[k]) for k in order.tolist()), np.uint8)
        state, active = runs.learn(answer)
        bounds = runs.state.bounds
        reach = max(int(b.max(initial=0)) for b in bounds) if bounds else UNBOUNDED
    return _state_row(chunk, state, active, reach)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SMALLER.split(", ")]
    kinds = pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
    for batch in batches:
        for chunk, static, state, active, reach in _rows_of(batch, "chunk", "packed", "state", "active", "reach"):
            row = chunk, *_smaller(static, state), active, reach
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


def _state_row(chunk: int, state: bytes, active: int, reach: int) -> pa.Table:
    kinds = (chunk, pa.int64()), (state, pa.binary()), (active, pa.int64()), (reach, pa.int64())
    return pa.table([pa.array([v], t) for v, t in kinds], [x.split()[0] for x in STATES.split(", ")])


def _first_state(known: pa.Table, flags: pa.Table) -> pa.Table:
    """Rows of which the reference has another copy are one phrase and ask nothing; of equal texts one row supplies."""
    chunk, static = known.column("chunk")[0].as_py(), known.column("packed")[0].as_py()
    counts = _plain(static)[1]
    asks, supplies = np.zeros(len(counts), bool), np.zeros(len(counts), bool)
    at = flags.column("at").to_numpy()
    asks[at] = flags.column("asks").to_numpy(zero_copy_only=False)
    supplies[at] = flags.column("supplies").to_numpy(zero_copy_only=False)
    lengths = np.ones(int(counts.sum()), np.int32)
    whole = ~asks & (counts > 0)
    lengths[(np.cumsum(counts) - counts)[whole]] = counts[whole]
    none = np.zeros(0, np.int32)
    state = State.packed(asks, supplies, lengths, np.zeros(len(lengths), bool), np.zeros(len(lengths), bool), [], none, none)
    return _state_row(chunk, state, int(asks.sum()), UNBOUNDED)


def _scores(batches: Iterator[pa.RecordBatch], reference_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for static, base, state, good in _rows_of(batch, "packed", "base", "state", "good"):
            ids, counts, own, *_ = _plain(static)
            lengths, rows, start = _whole_lengths(base, state).tolist(), [], 0
            for doc_id, n, phrases, mine in zip(ids, counts.tolist(), own, good):
                at = start
                crossed = 0
                while at < start + n:
                    at += lengths[at]
                    crossed += 1
                start += n
                rows.append((doc_id, *rates(n, crossed, phrases, reference_words - n * mine)))
            yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCORES.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.float64(), pa.float64()]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class _Bucketed:
    """Tables bucketed by chunk in the shared folder; joins of them move nothing."""

    def __init__(self, spark, parts: int) -> None:
        self.spark, self.parts, self.kept = spark, parts, []

    def write(self, frame: DataFrame, label: str) -> DataFrame:
        name = f"crossparse_{label}_{uuid.uuid4().hex}"
        path = shared_path(self.spark, f"crossparse-{label}")
        frame.write.bucketBy(self.parts, "chunk").option("path", path).option("compression", "none").saveAsTable(name)
        self.kept.append((name, path))
        return self.spark.table(name)

    def drop_old(self, label: str) -> None:
        """Deletes the last table but one of this label, then the shuffle files that nothing refers to any more."""
        places = [k for k, (name, _) in enumerate(self.kept) if name.startswith(f"crossparse_{label}_")]
        if len(places) < 2:
            return
        name, path = self.kept.pop(places[-2])
        self.spark.sql(f"DROP TABLE {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        self.spark._jvm.System.gc()


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, in_reference) against all other rows whose ``in_reference`` is true.

    Returns doc_id, n_words, n_phrases, own_phrases, reference_words (of the reference rows other than the row itself),
    cross_bits and score, both in bits a word; low: like the reference.  Words are ``[^\\x20\\x09-\\x0D]+``.

    A text of which another row of the reference has a copy is one phrase.  Null and empty texts have no words and null
    scores; null ``in_reference`` counts as false.  Null and repeated doc_ids are scored row by row, equal texts with equal
    ``in_reference`` equally.  Without reference every word is a phrase.  An empty table gives no rows.  Whole texts of any
    length, which must each fit into a worker; ``block_bytes`` and ``part_bytes`` size the chunks and don't change the
    result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce("in_reference", F.lit(False)).alias("of_reference"),
        F.xxhash64("text").alias("key"),
        F.xxhash64(F.lit("other"), F.col("text")).alias("other"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    tables = _Bucketed(spark, parts)
    packed = rows.mapInArrow(lambda b: _pack(b, block_bytes), CHUNKS).repartition(parts, "chunk")
    chunks = tables.write(packed, "chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "others", "good", "counts")).alias("at", "x"))
    each = each.select("chunk", "at", "x.keys", "x.others", "x.good", "x.counts")
    copies = each.filter("good").groupBy("keys", "others").agg(
        F.count("*").alias("copies"), F.min(F.struct("chunk", "at")).alias("first"), F.sum("counts").alias("words")
    )
    reference_words = copies.agg(F.sum("words")).first()[0] or 0
    others = F.coalesce("copies", F.lit(0)) - F.col("good").cast("int")
    supplies = F.coalesce(F.struct("chunk", "at") == F.col("first"), F.lit(False))
    flags = each.join(copies, ["keys", "others"], "left").select(
        F.col("chunk").alias("receiver"), "at", ((others == 0) & (F.col("counts") > 0)).alias("asks"), supplies.alias("supplies")
    )
    static = chunks.select("chunk", "packed")
    first = static.groupBy("chunk").cogroup(flags.groupBy("receiver")).applyInArrow(_first_state, STATES)
    state = tables.write(first, "state")

    def round_of(*what) -> int:
        nonlocal state
        known = static.join(state.select("chunk", "state", "reach"), "chunk")
        least = {"rise": what[1], "census": LONG + 1, "fall": 3 * what[1]}[what[0]]
        sent = known.filter(F.col("reach") >= least).drop("reach").mapInArrow(lambda b: _send(b, what, parts), SENT)
        answers = sent.groupBy("part").applyInArrow(_answer, ANSWERS)
        learnt = known.groupBy("chunk").cogroup(answers.groupBy("receiver")).applyInArrow(
            lambda x, y: _learn(x, y, what), STATES
        )
        state = tables.write(learnt, "state")
        active = (state.agg(F.sum("active")).first()[0] or 0) if what[0] == "rise" else 0
        tables.drop_old("state")
        return active

    base = chunks.select("chunk", F.lit(None).cast("binary").alias("base"))
    size, before = 2, 0
    while total and round_of("rise", size, before):
        if size == LONG:
            left = static.join(state, "chunk").mapInArrow(_reduce, SMALLER)
            smaller = tables.write(left, "smaller")
            static, base = smaller.select("chunk", "packed"), smaller.select("chunk", "base")
            state = smaller.select("chunk", "state", "active", "reach")
        size, before = size + 1 if size < LONG else 2 * size, size
    if size > 2 * LONG:
        round_of("census", 0, 0)
    step = size // 4 if size > LONG else 0
    while step:
        round_of("fall", step, 0)
        step //= 2
    found = chunks.select("chunk", "packed", "good").join(base, "chunk").join(state.select("chunk", "state"), "chunk")
    return found.mapInArrow(lambda b: _scores(b, reference_words), SCORES)


def score_against(docs: DataFrame, reference: DataFrame, most_bytes: int = MOST_REFERENCE) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) against all texts of ``reference`` (text), which is another table.

    The same columns and rules as ``score``, but no row is left out of the reference.  The reference goes to every worker,
    as a suffix automaton; one of more than ``most_bytes`` is an error.  Null and empty reference texts have no words.
    """
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a reference of {size} bytes: put it into the table and use score()")
    texts = [r[0].encode().split() for r in reference.select("text").collect() if r[0]]
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    words = sum(map(len, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = suffix_automaton(x for t in sent.value for x in [*t, None])
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), blobs(part.column("text"))):
                    found = text.split()
                    rows.append((doc_id, *rates(len(found), cross_phrases(moves, found), own_phrases(found), words)))
                yield _table(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCORES)
