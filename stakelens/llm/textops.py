"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and 0x09-0x0D; a text that is null has none.
Hashes are polynomials modulo 2**64 with a mixed finish, equal on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
BATCH_BYTES = 4 << 20
SMALL_RUN = 1 << 20  # for steps whose arrays of a run take many times its bytes
BLOCK_BYTES = 1 << 18  # hashed at once: sums and powers of a run take 32 times its bytes
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function of a task, after which its worker gives freed memory back to the system.

    Workers stay for later tasks. What they have freed would else still count as theirs while
    another stage, perhaps without Python, needs the memory of the machine.
    """

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """The finish of splitmix64: spreads every bit of x over the result."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _salted(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_ODD) + U(seed * 0x2545F4914F6CDD1D & _MASK))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up, self.down = np.full(size, self.base, U), np.full(size, self.inverse, U)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down


_BYTE_POWERS = _Powers(0xD1342543DE82EF95)
_WORD_POWERS = [_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB)]


class Words(NamedTuple):
    """Words of a run of texts: byte ranges, hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # texts + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(
    column: pa.Array, limit: int = BATCH_BYTES, most: int = 1 << 62
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about `limit` bytes; null is empty.

    A run has at most `most` texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column), at + most)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]], never across two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    table = _salted(256, 1)
    if lower:
        table[65:91] = table[97:123]
    hashes = np.empty(len(start), U)
    a = 0
    while a < len(start):
        low = start[a]
        b = int(np.searchsorted(start, low + BLOCK_BYTES))
        hashes[a:b] = _spans(table[data[low : end[b - 1]]], start[a:b] - low, end[a:b] - low)
        a = b
    return Words(data, start, end, mix(hashes), np.searchsorted(start, offsets))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of the values of each span, plus its length; the same wherever it begins."""
    up, down = _BYTE_POWERS.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start] + (end - start).astype(U)


def windows(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `length` words, by its first word; two choices of `which` differ."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, U)
    up, down = _WORD_POWERS[which].to(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(mix(hashes + U(which)) * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def within(first: np.ndarray, length: int) -> np.ndarray:
    """Whether the window from each word lies in one text; an entry for each window."""
    n = int(first[-1])
    if n < length:
        return np.zeros(0, bool)
    owner_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n - length + 1)
    return at + length <= owner_end[: n - length + 1]


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [start, end)."""
    steps = np.bincount(start, minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a number per word, for each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
