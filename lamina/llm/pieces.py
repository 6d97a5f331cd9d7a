"""Token ids of texts from the ids of their distinct segments.

A tokenizer that never joins across certain cuts may encode each segment between cuts by itself.
Segments are hashed in columns, each distinct one is encoded once while it stays in a bounded cache,
and the ids of a text are gathered from the cache's pool.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np

from .words import SLICE_BYTES, hash_spans, row_slices, spread, text_buffer

CACHE_SEGMENTS = 250_000
CACHE_IDS = 4_000_000  # 16 MB


class SegmentCache:
    """Ids of segments by their hash. ``encode_all`` takes the new segments of a slice at once and gives (ids, counts)."""

    def __init__(self, encode_all: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_SEGMENTS, limit_ids: int = CACHE_IDS):
        self.encode_all, self.limit, self.limit_ids = encode_all, limit, limit_ids
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.pool, self.at = array("i"), array("q", [0])

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in order, and the number of ids of each."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.index) > self.limit or len(self.pool) > self.limit_ids:
            self.clear()
        h = hash_spans(buf, start, end, lower=False)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        where = np.fromiter((self.index.get(x, -1) for x in u.tolist()), np.int64, len(u))
        new = np.flatnonzero(where < 0)
        if len(new):
            data, base = buf.tobytes(), len(self.at) - 1
            ids, count = self.encode_all([data[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            self.at.frombytes((len(self.pool) + np.cumsum(count, dtype=np.int64)).tobytes())
            self.pool.frombytes(np.ascontiguousarray(ids, np.int32).tobytes())
            where[new] = base + np.arange(len(new))
            self.index.update(zip(u[new].tolist(), range(base, base + len(new)), strict=True))
        seg = where[inverse]
        at = np.frombuffer(self.at, np.int64)
        count = at[seg + 1] - at[seg]
        out = np.frombuffer(self.pool, np.int32)[spread(at[seg], count)]
        return out, count


def one_by_one(encode: Callable[[bytes], list[int]]) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """``encode_all`` of a tokenizer that takes one segment."""

    def encode_all(segments):
        out = [encode(x) for x in segments]
        return np.fromiter((i for ids in out for i in ids), np.int32), np.fromiter(map(len, out), np.int64, len(out))

    return encode_all


def text_ids(col, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], cache: SegmentCache, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, end row, ids, and the bounds of each row's ids.

    cuts(bytes, row offsets) gives the sorted starts of the segments, with the start of each row.
    """
    buf, offsets = text_buffer(col)
    for lo, hi in row_slices(offsets, limit):
        part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start = cuts(part, at)
        end = np.append(start[1:], len(part)) if len(start) else start
        ids, count = cache.ids(part, start, end)
        total = np.concatenate([[0], np.cumsum(count)])
        yield lo, hi, ids, total[np.searchsorted(start, at)]
