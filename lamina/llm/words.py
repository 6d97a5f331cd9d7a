"""Vectorised word access to Arrow text columns inside tasks.

Words are runs of bytes other than space and 0x09-0x0D. A batch is cut into slices of bounded text,
and each slice yields flat numpy arrays: word hashes, byte bounds and the word range of each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_EXACT = np.arange(1, 257, dtype=np.uint64)
_LOWER = _EXACT.copy()
_LOWER[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[ord("A") : ord("Z") + 1] += 32
_P = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)
_LONG = 32  # bytes of a word hashed in columns; longer words go through xxhash


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass
class Slice:
    """Rows ``lo`` to ``hi`` of a batch. ``row`` has the bounds of each row's words."""

    lo: int
    hi: int
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    bytes_at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(at):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans; ``lower`` folds A-Z only."""
    size = end - start
    short = np.minimum(size, _LONG + 1).astype(np.int16)
    order = np.argsort(-short, kind="stable")
    at = start[order]
    many = np.cumsum(np.bincount(short, minlength=_LONG + 2)[::-1])[::-1]
    code = _LOWER if lower else _EXACT
    h = np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(_LONG):
            k = int(many[j + 1])
            if not k:
                break
            h[:k] = h[:k] * _P + code[buf[at[:k] + j]]
        out = np.empty_like(h)
        out[order] = h
        out = mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in order[: int(many[_LONG + 1])]:
        span = buf[start[i] : end[i]]
        out[i] = xxhash.xxh64_intdigest((_LOWER_BYTES[span] if lower else span).tobytes(), 7)
    return out


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = _SEPARATOR[buf]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = sep[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = True
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after[edge - 1] = True
    return np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1


def slices(col, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The words of a text column, slice by slice."""
    buf, offsets = text_buffer(col)
    for lo, hi in row_slices(offsets, limit):
        part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end = word_bounds(part, at)
        yield Slice(lo, hi, part, start, end, hash_spans(part, start, end, lower), np.searchsorted(start, at), at)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words, by start; windows run across rows (the caller masks those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


def shingles(s: Slice, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice and their bounds by row; a row of fewer words is one shingle, an empty row none."""
    counts = s.counts()
    out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(out)])
    got = np.empty(at[-1], dtype=np.uint64)
    full = window_hashes(s.hash, size)
    long_rows = np.flatnonzero(counts >= size)
    if len(long_rows):
        got[spread(at[long_rows], out[long_rows])] = full[spread(s.row[long_rows], out[long_rows])]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        got[at[i]] = window_hashes(s.hash[s.row[i] : s.row[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i])
    return got, at


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    jump = np.ones(total, dtype=np.int64)
    keep = count > 0
    first, count = first[keep], count[keep]
    jump[0] = first[0]
    jump[np.cumsum(count)[:-1]] = first[1:] - first[:-1] - count[:-1] + 1
    return np.cumsum(jump)
