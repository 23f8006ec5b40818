"""Vectorised word and shingle hashes over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z.
Every word gets a 64-bit hash from prefix sums of a polynomial over its bytes, so a whole
block of texts costs a few NumPy passes and no Python object for a word. Equal words have
equal hashes; distinct words share one with a chance of about 2**-58 for a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # hashes wrap on purpose

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

U = np.uint64
BLOCK_BYTES = 1 << 19  # text handled at once; bounds memory, not results: longer texts form a block of their own
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _letters() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
    table[65:91] = table[97:123]
    return table


LETTERS = _letters()
CASED = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))  # letters of both cases stay apart
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        tables = []
        for b in (BASE, inverse):
            t = np.full(size, U(b), dtype=U)
            t[0] = U(1)
            tables.append(np.cumprod(t, dtype=U))
        _powers[:] = tables
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the polynomial before each byte, and the inverse powers that make them independent of the place."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    terms = letters[data]
    terms *= power[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums, inverse


@dataclass
class Words:
    """Words of a block of texts, in text order. ``bounds[d]:bounds[d+1]`` are those of row ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    last: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word, or of all of a shorter word."""
        end = np.minimum(self.first + n, self.last)
        return mix((self.sums[end] - self.sums[self.first]) * _powers[1][self.first] + U(n))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, letters: np.ndarray = LETTERS, spaces: np.ndarray = SPACES) -> Words:
    data, offsets = raw(column)
    n = len(data)
    solid = ~spaces[data]
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | start[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | start[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums, inverse = prefix_sums(data, letters)
    hashed = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U))
    return Words(data, offsets, first, last, np.searchsorted(first, offsets), sums, hashed)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in text order with repeats, and row bounds; a row with fewer words has its whole sequence as one."""
    n, counts = len(w.hash), np.diff(w.bounds)
    size = max(n - k + 1, 0)
    total = np.zeros(size, U)
    for j in range(k):
        total += w.hash[j : j + size] * U(((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) | 1)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(bounds[-1], U)
    long_rows = counts >= k
    at = np.repeat(w.bounds[:-1][long_rows] - bounds[:-1][long_rows], each[long_rows])
    where = np.flatnonzero(np.repeat(long_rows, each))
    out[where] = mix(total[where + at])
    for d in np.flatnonzero((counts > 0) & ~long_rows):
        part = w.hash[w.bounds[d] : w.bounds[d + 1]]
        odd = [((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) | 1 for j in range(len(part))]
        out[bounds[d]] = mix(mix((part * np.array(odd, U)).sum(dtype=U, keepdims=True)) + U(len(part)))[0]
    return out, bounds


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges of about ``limit`` bytes of text; every row is kept whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give what a finished task held back to the system: the worker serves other work next, and allocators keep what they had."""
    if _powers and len(_powers[0]) > BLOCK_BYTES + 1:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h + U((seed + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
