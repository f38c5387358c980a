"""Texts of an Arrow batch as NumPy arrays, in slices of bounded size.

All byte-level work of the subpackage runs on these arrays: a slice holds
whole documents, at most ``max_bytes`` of them together (one longer document
makes a slice of its own), so a worker's memory follows the longest document
and not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
#: Space as the contracts define it: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and nothing else; UTF-8 keeps ASCII bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache
def steady_memory() -> None:
    """Has a Python worker give large arrays back to the system as soon as they are freed.

    By default the C library keeps them once it has seen a few, and so does
    Arrow's pool: an idle worker then holds what its largest batch took.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD


def release_memory() -> None:
    """Gives freed heap back to the system, after a fit on the driver."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift-multiply), wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over the whole column."""
    steady_memory()
    data, at = buffers(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + max_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


class PolyHash:
    """64-bit hashes of any span of a byte (or code point) array in O(1).

    Each symbol is drawn through a table of random odd values before the
    polynomial, and each span's value through ``mix64`` after it, so equal
    spans have equal hashes wherever they stand.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(int(rng.integers(1 << 61, 1 << 62)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = np.ones(1, np.uint64)
        self.unpowers = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) >= n:
            return
        n = max(n, 2 * len(self.powers))
        for name, base in (("powers", self.base), ("unpowers", self.inverse)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``spans`` reads."""
        self._grow(len(symbols) + 2)
        if symbols.dtype == np.uint8:
            value = self.table[symbols]
        else:  # two draws cover all code points
            value = self.table[symbols & 0xFFF] + self.table[(symbols >> 12) & 0xFFF] * np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(value * self.powers[: len(symbols)], out=out[1:])
        return out

    def raw(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position-free polynomial value of each span."""
        return (sums[end] - sums[start]) * self.unpowers[start]

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(sums, start, end) + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
