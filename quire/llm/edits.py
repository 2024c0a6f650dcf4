"""Edit-aware token counting.

Byte-level BPE never merges across the borders of its pre-tokens, so a document's count is the sum over its pre-tokens.
They are kept, a run of them a leaf, in a segment tree with the sums of characters and tokens.  An edit finds its leaf by
descending the character sums, splits again only the pre-tokens it touches and the context whose split could depend on
them, until a new border falls on an old one behind the edit, and updates the sums on the leaves' paths to the root.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices

COUNTS = (
    "doc_id bigint, tokens_before bigint, tokens_after bigint, n_edits bigint, n_pretokens bigint, n_reencoded bigint, "
    "chars_after bigint"
)
#: Pre-tokens whose counts a worker remembers before it forgets all.
LIMIT = 450_000
#: Characters behind a pre-token that its border may depend on.
LOOK = 2

Edit = tuple[int, int, str]


class _Counts(dict):
    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, pretoken: str) -> int:
        n = len(self.encode(pretoken))
        if len(self) >= LIMIT:
            self.clear()
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each; one a Python worker."""

    _cache: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding(
            "edits", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.count = _Counts(encoding.encode_ordinary).__getitem__

    @classmethod
    def cached(cls, path: str) -> Counter:
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]


class TokenTree:
    """The pre-tokens of one text under a segment tree of sums."""

    def __init__(self, text: str, counter: Counter, run: int = 64) -> None:
        self.counter, self.run, self.reencoded = counter, run, 0
        self._build(counter.split(text))

    def _build(self, pretokens: list[str]) -> None:
        run = self.run
        self.leaves = [pretokens[i : i + run] for i in range(0, len(pretokens), run)] or [[]]
        self.size = size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * size), [0] * (2 * size)
        for k, leaf in enumerate(self.leaves):
            self.chars[size + k] = sum(map(len, leaf))
            self.sums[size + k] = sum(map(self.counter.count, leaf))
        for k in range(size - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(x for leaf in self.leaves for x in leaf)

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, or the last one, and the position of its first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= position:
                start += self.chars[k]
                k += 1
        k -= self.size
        while k >= len(self.leaves):
            k -= 1
            start -= self.chars[self.size + k]
        return k, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` up to ``end``."""
        if not 0 <= start <= end <= self.length:
            raise ValueError("the edit lies outside the text")
        leaf, position = self._leaf(max(0, start - LOOK))
        kept, at = [], position
        first = self.leaves[leaf]
        while len(kept) < len(first) and at + len(first[len(kept)]) + LOOK <= start:
            at += len(first[len(kept)])
            kept.append(first[len(kept)])
        old = first[len(kept) :]  # old pre-tokens from ``at`` on
        shift, last, want = len(new) - (end - start), leaf, end + 1
        while True:
            have = at + sum(map(len, old))
            while have < want and last + 1 < len(self.leaves):
                last += 1
                old = old + self.leaves[last]
                have += self.chars[self.size + last]
            whole = last + 1 == len(self.leaves)
            before = "".join(old)
            local = before[: start - at] + new + before[end - at :]
            borders, b = {at: 0}, at
            for k, x in enumerate(old):
                b += len(x)
                borders[b] = k + 1
            fresh, b, rest = [], at, None
            limit = at + len(local)
            for x in self.counter.split(local):
                if b - shift >= end and b - shift in borders and (whole or b + LOOK <= limit):
                    rest = borders[b - shift]
                    break
                if not whole and b + len(x) + LOOK > limit:
                    break
                fresh.append(x)
                b += len(x)
            else:
                rest = len(old) if whole else None
            if rest is not None:
                break
            want = have + max(1, have - at)  # not in step yet: twice as much context
        self.reencoded += len(fresh)
        self.leaves[leaf] = kept + fresh + old[rest:]
        if len(self.leaves[leaf]) > 8 * self.run:
            for k in range(leaf + 1, last + 1):
                self.leaves[k] = []
            self._build([x for part in self.leaves for x in part])
            return
        for k in range(leaf, last + 1):
            if k > leaf:
                self.leaves[k] = []
            self._refresh(k)

    def _refresh(self, leaf: int) -> None:
        k = self.size + leaf
        self.chars[k] = sum(map(len, self.leaves[leaf]))
        self.sums[k] = sum(map(self.counter.count, self.leaves[leaf]))
        while k > 1:
            k >>= 1
            self._add(k)

    def apply(self, edits: Iterable[Edit]) -> int:
        """Applies edits given in positions of the present text, which don't overlap; returns their number."""
        ordered = sorted(edits, key=lambda e: (e[0], e[1]), reverse=True)
        for start, end, new in ordered:  # from the end, so that positions before stay valid
            self.replace(start, end, new)
        return len(ordered)


_name = re.compile(r"[\w.+-]+")
_host = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_number = re.compile(r"\d[\d .()-]{5,}\d")


def redactions(text: str) -> list[Edit]:
    """Edits that replace e-mail addresses and long numbers (phones, cards, addresses of hosts)."""
    mails, stop = [], 0
    for m in _name.finditer(text) if "@" in text else ():  # each run once, so that long texts take linear time
        if text[m.end() : m.end() + 1] == "@" and m.end() > stop:
            host = _host.match(text, m.end() + 1)
            if host:
                mails.append((max(m.start(), stop), host.end(), "<mail>"))
                stop = host.end()
    numbers, k = [], 0
    for m in _number.finditer(text):
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k == len(mails) or m.end() <= mails[k][0]:
            numbers.append((m.start(), m.end(), "<number>"))
    return mails + numbers


def edited_counts(docs: DataFrame, vocabulary: str, edits: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """Token counts of every row of ``docs`` (doc_id, text) before and after ``edits(text)``, without a shuffle.

    Returns doc_id, tokens_before, tokens_after, n_edits, n_pretokens (before), n_reencoded (pre-tokens split again) and
    chars_after.  ``edits`` gives (start, end, new text) triples that don't overlap.

    Null text counts as empty: all zeros.  Null and repeated doc_ids are kept row by row.  An empty table gives no rows.
    Whole texts of any length; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.cached(vocabulary)
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    tree = TokenTree(text or "", counter)
                    before, pretokens = tree.tokens, sum(map(len, tree.leaves))
                    n = tree.apply(edits(text)) if text else 0
                    out.append((doc_id, before, tree.tokens, n, pretokens, tree.reencoded, tree.length))
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, COUNTS)
