"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  They are walked in slices of a few MB of
whole documents, so memory is bounded by the slice (or by the one longest text),
never by the partition.  A null text behaves like an empty one.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_OTHER = 0xC2B2AE3D27D4EB4F | 1
_OTHER_INV = pow(_OTHER, -1, 1 << 64)
_OTHER_LOWER = np.random.Generator(np.random.PCG64(977)).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_POW: dict[str, np.ndarray] = {}
_GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                  0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6C62B1F4D3A5B7], np.uint64)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * SLICE_BYTES:
            _POW[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Returns memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """run of batches, after which its worker holds no free memory: idle workers share the executor's limit with the stages that follow."""

    def rows(batches):
        yield from run(batches)
        give_back()

    return rows


def lean_table(run):
    """Like ``lean``, of a function of a group's table."""

    def table(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return table


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of whole texts, each of about ``limit`` bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(len(col), max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a slice: byte ranges, and each document's range of words in ``bounds``."""

    __slots__ = ("bounds", "data", "end", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, space: np.ndarray = _WS):
        self.data = data
        ws = np.ones(len(data) + 2, bool)
        ws[1:-1] = space[data]
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        body = ~ws[1:-1]
        self.start = np.flatnonzero(body & (ws[:-2] | first[:-1]))
        self.end = np.flatnonzero(body & (ws[2:] | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, lower: bool = True) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * _powers("p", _BASE, n)[:n], out=run[1:])
        back = _powers("i", _BASE_INV, n)
        return mix((run[self.end] - run[self.start]) * back[self.start])


    def checks(self) -> np.ndarray:
        """A second hash of the lower-cased words, independent of the first."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_OTHER_LOWER[self.data] * _powers("q", _OTHER, n)[:n], out=run[1:])
        return (run[self.end] - run[self.start]) * _powers("j", _OTHER_INV, n)[self.start] + (self.end - self.start).astype(np.uint64)


def grams(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a document, and each document's range of them."""
    count = np.maximum(np.diff(bounds) - (k - 1), 0)
    out = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], count)
    s = np.zeros(len(at), np.uint64)
    for i in range(k):
        s += h[at + i] * _GRAM[i]
    return mix(s), out


def spread(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of lo[0] .. lo[0]+count[0]-1, lo[1] .. in one array."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - (end - count), count)


def seg_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over bounds[i]:bounds[i+1]; empty ranges give 0, unsigned values wrap."""
    run = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return run[bounds[1:]] - run[bounds[:-1]]


def i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
