"""Vectorised views on Arrow text columns, shared by the operators of this subpackage.

All kernels work on one bounded slice of a batch at a time (``slices``), so the
memory of a task follows the slice size and the longest single text, not the
number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 4 << 20


def trim() -> None:
    """Gives freed memory back to the system; a Python worker lives on beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as UTF-8 binary; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type) and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``limit`` text bytes (or one longer row)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in a row, and the offsets at which rows begin and end."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def from_raw(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary array over consecutive pieces of ``data``."""
    kind = kind or pa.large_binary()
    wide = pa.types.is_large_binary(kind) or pa.types.is_large_string(kind)
    off = np.ascontiguousarray(offsets, dtype=np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of non-space bytes; runs never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end = np.zeros(len(data) + 1, bool)
    end[1:-1] = solid[:-1] & (~solid[1:] | first[1:-1])
    end[-1] = solid[-1]
    return np.flatnonzero(begin), np.flatnonzero(end)


_BASE = 0xD1342543DE82EF95
#: Bytes that are hashed in one go; longer data are a chain of such pieces.
_PIECE_BITS = 16
_PIECE = 1 << _PIECE_BITS


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, for one piece."""
    with np.errstate(over="ignore"):
        up, down = np.full(_PIECE, _BASE, np.uint64), np.full(_PIECE, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _steps(count: int, base: int) -> np.ndarray:
    """The power of the base at the begin of each piece."""
    step, out = pow(base, _PIECE, 2**64), [1]
    while len(out) < count:
        out.append(out[-1] * step % 2**64)
    return np.array(out, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all their bits are usable."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span that depends on its bytes alone."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    count = len(data) // _PIECE + 1
    lift, lower = _steps(count, _BASE), _steps(count, pow(_BASE, -1, 2**64))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        for k, a in enumerate(range(0, len(data), _PIECE)):
            codes = _BYTE_CODES[data[a : a + _PIECE]]
            codes *= up[: len(codes)]
            codes *= lift[k]
            codes[0] += sums[a]
            np.cumsum(codes, out=sums[a + 1 : a + 1 + len(codes)])
        h = sums[end]
        h -= sums[begin]
        del sums
        h *= down[begin & (_PIECE - 1)]
        h *= lower[begin >> _PIECE_BITS]
        return mix(h + (end - begin).astype(np.uint64) * _ODD)


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each byte position lies."""
    return np.searchsorted(offsets, positions, "right") - 1


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive codes (len - n + 1 of them)."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    m = len(codes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return h


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def earlier(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before each key."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
