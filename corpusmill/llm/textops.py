"""Vectorised work on whole Arrow text columns: words, hashes, windows, packing of numbers.

Texts stay in Arrow's buffers; words are (start, end) byte positions and 64-bit
hashes in numpy arrays, so no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds a worker's memory (a longer text is handled alone).
SLICE_BYTES = 4 << 20

#: The bytes \x20 and \x09-\x0D separate words; all others belong to words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_LONG_WORD = 64
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for unsigned 64-bit values (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column (null: empty), offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive rows of about ``limit`` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    _, at = text_buffers(batch.column(name))
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def find_words(raw: np.ndarray, at: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word
    (one entry more at the end)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~is_space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    size = ends - starts
    h = size.astype(np.uint64)
    left, j = np.flatnonzero((size > 0) & (size <= _LONG_WORD)), 0
    while len(left):
        h[left] = h[left] * _STEP + _BYTE_VALUES[raw[starts[left] + j]]
        j += 1
        left = left[size[left] > j]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def rolling(h: np.ndarray, n: int, step: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive values (across texts, too: see ``whole``)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= np.uint64(step)
        acc += h[j : m + j]
    return mix(acc)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which the shuffle's compression shrinks well."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive groups of ``counts`` values, each as little-endian bytes."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.dtype.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def numbers(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``binaries`` has packed: all values, and where each row's begin (one entry more at the end)."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), (at - at[0]) // width


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i]+1, ... (counts[i] of them), one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def longs(column: pa.Array, null: int) -> np.ndarray:
    """A column of integers as int64 (null: the given value)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
