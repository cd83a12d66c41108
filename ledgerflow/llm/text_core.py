"""Vectorised byte-level text primitives on Arrow batches (numpy only).

Texts of one batch are handled as one UTF-8 byte buffer: words are found with a
byte-class table and hashed with one prefix sum, so the cost is a few array
passes per byte and no Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once



def _return_memory() -> None:
    """Freed arrays go back to the system: a worker lives for many tasks.

    glibc keeps freed blocks below a threshold that grows with use, and Arrow's own
    pool keeps what it had; both are fixed here (options -3: mmap, -1: trim).
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)
        libc.mallopt(-1, 8 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give free pages back at the end of a task: the worker goes on to other stages."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_return_memory()
_R = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        n = max(n, CHUNK + 1024)
        for k, r in enumerate((_R, _R_INV)):
            a = np.full(n, r, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    n = batch.num_rows
    _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-space bytes within a text, and words per text."""
    return spans_of(data, offs, ~_SPACE)


def spans_of(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for runs of bytes that ``kind`` (a table of 256 flags) marks."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    word = kind[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = word[tails]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.diff(np.searchsorted(s, offs))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of data[s:e] for each span."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
    return splitmix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    s, e, per = word_spans(data, offs)
    return span_hashes(data, s, e, lower), per, s, e


def shingles(h: np.ndarray, per: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text, and their number per text.

    With ``short``, a text of 1 to k-1 words has its whole sequence as its one run.
    """
    ends = np.cumsum(per)
    starts = ends - per
    n_run = np.maximum(per - k + 1, 0)
    run = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        x = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            x = x * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(x)]
        run[: len(x)] = splitmix(x)
    if short:
        few = np.flatnonzero((per > 0) & (per < k))
        for i in few:
            x = int(per[i])
            for w in h[starts[i] : ends[i]]:
                x = (x * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF
            run[starts[i]] = splitmix(np.array([x], np.uint64))[0]
        n_run[few] = 1
    keep = np.ones(len(h), bool)
    tail = per - n_run
    if tail.any():
        idx = np.repeat(ends - tail, tail) + (np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail))
        keep[idx] = False
    return run[keep], n_run
