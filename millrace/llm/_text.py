"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes that are not ASCII white space (0x20, 0x09-0x0D); A-Z are
folded to a-z.  Hashes are 64 bits wide and depend on content only, never on the worker.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1_000_000
BATCH = 2_000_000
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        n = max(n, CHUNK)
        have = np.cumprod(np.concatenate([[U(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        _powers[name] = have
    return have


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, row offsets within these bytes), about CHUNK bytes at a time; a longer row comes alone."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, A-Z folded."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up = _power("up", _BASE, len(data))
    down = _power("down", pow(_BASE, -1, 2**64), len(data))
    total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_rows(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, hashes of the n-word shingles in text order) of each row; fewer words make one shingle, none make none."""
    for _, _, data, off in slices(column):
        start, end, counts = words(data, off)
        h = span_hash(data, start, end)
        flat = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for j in range(n if len(flat) else 0):
            flat += mix(h[j : j + len(flat)] + _STEP[j]) * _STEP[j + 1]
        flat, at = mix(flat), 0
        for c in counts.tolist():
            if c >= n:
                yield c, flat[at : at + c - n + 1]
            elif c:
                short = U(c)
                for j in range(c):
                    short = mix(mix(h[at + j : at + j + 1] + _STEP[j]) * _STEP[j + 1] + short)
                yield c, short
            else:
                yield 0, flat[:0]
            at += c


def halved(batch: pa.RecordBatch, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most about size bytes, one row at least; nothing is copied."""
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), size)
        yield from halved(batch.slice(half), size)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, over batches of bounded size whatever the session sends; at the task's end the worker, which lives on, gives its memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in halved(batch))
        finally:
            release()

    return wrapped


def release() -> None:
    from . import _tokens

    for e in _tokens._encoders.values():
        e.forget()
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
