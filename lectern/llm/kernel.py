"""Words, shingles and lines of many texts at once, from the bytes of Arrow string arrays.

A text never becomes Python strings here: words are found as runs of bytes that are not ASCII white space (in UTF-8
no byte of another character looks like one) and named by a 64-bit polynomial hash taken from prefix sums, so that
every step is a numpy operation over a block of half a megabyte. Two different words share a name with a chance of
about 2**-64; all counts built on names hold up to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK = 1 << 19

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_P = U(0xD1342543DE82EF95)
_P_INV = U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x bears on every bit of the result."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _ODD)
_STEP = np.arange(256, dtype=U) * _ODD
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            steps = np.full(n, p, U)
            steps[0] = U(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """A block of texts: data (bytes of all), at (where each begins, and the end of the last)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at.astype(np.int64), len(at) - 1

    def take(self, rows: np.ndarray) -> Texts:
        """A block of some of the texts."""
        if len(rows) == self.n:
            return self
        size = np.diff(self.at)[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        return Texts(self.data[np.repeat(self.at[:-1][rows] - at[:-1], size) + np.arange(at[-1])], at)

    def mapped(self, table: np.ndarray) -> Texts:
        """The same texts with each byte replaced by a table's."""
        return Texts(table[self.data], self.at)

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.data)
        pw, ipw = _power(size + 1)
        prefix = np.zeros(size + 1, U)
        np.cumsum(_BYTE[self.data] * pw[:size], out=prefix[1:])
        return prefix, ipw

    def names(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit name for each run of bytes."""
        prefix, ipw = self._sums
        h = (prefix[end] - prefix[begin]) * ipw[begin]
        return mix(h + (end - begin).astype(U) * _ODD)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, and per text the number of its first word (one more entry than texts)."""
        size = len(self.data)
        word = np.zeros(size + 2, bool)
        word[1:-1] = ~_SPACE[self.data]
        edge = np.zeros(size + 1, bool)
        edge[self.at] = True
        begin = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        return begin, end, np.searchsorted(begin, self.at)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text the sum over its bytes."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    @cached_property
    def word_names(self) -> np.ndarray:
        begin, end, _ = self.words
        return self.names(begin, end)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the lines that have a word begin and end (split at newlines), and the text of each."""
        size = len(self.data)
        newline = np.flatnonzero(self.data == 0x0A)
        begin = np.unique(np.concatenate([self.at[:-1], newline + 1]))
        begin = begin[begin < size]
        end = np.append(begin[1:], size)[: len(begin)]
        # a line ends before its newline, or where its text ends
        end = end - (self.data[end - 1] == 0x0A)
        first, _, _ = self.words
        has = np.searchsorted(first, end) > np.searchsorted(first, begin)
        begin, end = begin[has], end[has]
        return begin, end, np.searchsorted(self.at, begin, "right") - 1

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of all windows of k words, and per text the number of its first window (windows stay inside texts)."""
        _, _, first = self.words
        return grams(self.word_names, first, k)


def grams(names: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(np.diff(first) - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    total = np.zeros(at[-1], U)
    for i in range(k):
        total += mix(names[take + i] + _STEP[i + 1])
    return mix(total), at


def shingles(block: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's windows of k words, sorted, and where each set begins.

    A text of 1 to k - 1 words has one shingle made of all of them; a text without words has none.
    """
    names, at = block.grams(k)
    _, _, first = block.words
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < k))
    owner = np.repeat(np.arange(block.n), np.diff(at))
    if len(short):
        own = block.word_names
        extra = []
        for t in short:
            w = own[first[t] : first[t + 1]]
            extra.append(mix(np.array([mix(w + (np.arange(len(w)) + 101).astype(U) * _ODD).sum(dtype=U)], U))[0])
        names = np.concatenate([names, np.array(extra, U)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    keep = np.ones(len(names), bool)
    keep[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    names, owner = names[keep], owner[keep]
    return names, np.searchsorted(owner, np.arange(block.n + 1))


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Cut an Arrow string array into blocks of about `most` bytes: (first row, row after the last, Texts). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Cut an Arrow string array into slices (first row, row after the last) of at most so many bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches in which equal keys lie together: tables of whole groups, and where each group begins and the last ends.

    Holds one batch and the group that its end cuts; callers bound their groups.
    """
    held: list[pa.Table] = []

    def bounds(table: pa.Table) -> np.ndarray:
        differs = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in keys:
            c = table.column(k).to_numpy()
            differs |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(differs) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
        at = bounds(table)
        held = [table.slice(at[-1])]
        if at[-1]:
            yield table.slice(0, at[-1]), at
    if held:
        table = held[0].combine_chunks()
        yield table, np.append(bounds(table), table.num_rows)


def labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, each row's component, named by its smallest row."""
    m = len(linked)
    label = np.arange(m)
    while True:
        low = np.where(linked, label[None, :], m).min(1)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
