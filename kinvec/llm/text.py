"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column, many documents
at a time, with numpy only; no per-character Python.  Texts are whole: a chunk
is a run of consecutive rows, and a row is never split over two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), element by element."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


_POW: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (or of the inverse of base)."""
    have = _POW.get((base, inverse))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        step = np.full(size, pow(base, -1, 2**64) if inverse else base, dtype=U64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 21:
            _POW[(base, inverse)] = have
    return have[:n]


def forget() -> None:
    """Let go of the powers kept; they are soon worked out again."""
    _POW.clear()


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence, in O(1) each."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * powers(n, base), out=self.sums[1:])
        self.inv = powers(n + 1, base, inverse=True)

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of that length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=U64)
        return mix((self.sums[length:] - self.sums[:n]) * self.inv[:n])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(U64))


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


class Chunk:
    """Consecutive rows: data (all bytes), offsets (n + 1, into data), rows (slice of the batch)."""

    __slots__ = ("data", "offsets", "rows")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, target: int = 1 << 20) -> Iterator[Chunk]:
    """The rows in runs of about `target` bytes; a longer text is a run of its own."""
    data, offsets = utf8(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield Chunk(data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64), slice(i, j))
        i = j


@lru_cache(maxsize=4)
def _separators(which: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(range(9, 14)) + [32]] = True
    return table


@lru_cache(maxsize=1)
def lower_az() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """The words (runs of bytes other than blank and 0x09-0x0D) of a chunk.

    start, end: byte positions in the chunk; doc: row of each word; first: n + 1
    offsets of each row's words; hash: 64 bits of each word; again: 64 others,
    where a second base is given.
    """

    def __init__(self, chunk: Chunk, lower: bool, second: int | None = None):
        data = lower_az()[chunk.data] if lower else chunk.data
        n = len(data)
        inside = ~_separators("space")[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = chunk.offsets[1:-1]
        cuts = cuts[cuts < n]
        begins[cuts] |= inside[cuts]
        ends = np.zeros(n + 1, dtype=bool)
        ends[1:n] = inside[:-1] & (~inside[1:] | begins[1:])
        if n:
            ends[n] = inside[n - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, chunk.offsets)
        self.doc = np.repeat(np.arange(len(chunk)), np.diff(self.first))
        codes = byte_codes()[data]
        self.hash = Rolling(codes).ranges(self.start, self.end)
        self.again = None if second is None else Rolling(codes, second).ranges(self.start, self.end)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal runs of a union of ranges; touching ranges are one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    head = np.ones(len(s), dtype=bool)
    head[1:] = s[1:] > e[:-1]
    tail = np.append(head[1:], True)
    return s[head], e[tail]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of that width, by doubling."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:])
    return out
