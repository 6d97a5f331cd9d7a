"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts become token ids; a text longer than a row is split into pieces of a whole row and a rest,
without loss. Pieces are placed in decreasing length, each into the row with the least room that
still fits it; a segment tree over the possible capacities finds that row in O(log row length).
Packing runs inside each task over windows of bounded tokens, so no text or id is shuffled.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SegmentCache, one_by_one, text_ids
from .shared import in_arrow

ROW = 2048
WINDOW_TOKENS = 4_000_000
PAD = 50256
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's own
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ENCODERS: dict = {}


def encoder(ranks: bytes):
    """A byte-level BPE of a rank file's content; one per worker process."""
    import tiktoken

    key = hash(ranks)
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def cuts(buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of segments that the pattern never crosses: row starts and single white space between other characters.

    No alternative of the pattern takes white space after something else, so a token starts there; a
    byte that may end a non-ASCII space before it is no place to cut.
    """
    n = len(buf)
    if n < 3:
        return np.unique(rows[:-1][rows[:-1] < n])
    space = _SPACE[buf]
    ok = np.zeros(n, dtype=bool)
    ok[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
    ok[2:] &= ~((buf[:-2] == 0xC2) & ((buf[1:-1] == 0x85) | (buf[1:-1] == 0xA0)))
    ok[3:] &= ~((buf[:-3] >= 0xE1) & (buf[:-3] <= 0xE3) & (buf[2:-1] >= 0x80))
    inner = rows[(rows > 0) & (rows < n)]
    ok[rows[rows < n]] = True
    last = inner - 1  # a space at the end of a row is followed by nothing
    ok[last[~np.isin(last, rows)]] &= False
    return np.flatnonzero(ok)


class Capacities:
    """Open rows by free capacity: a segment tree of which capacities have a row, and a heap of rows for each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        heap = self.rows.setdefault(free, [])
        heapq.heappush(heap, row)
        if len(heap) == 1:
            self._set(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of least capacity that is at least ``need``; of equals the first opened."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up until a right neighbour has a row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:  # down its left edge
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.size
        row = heapq.heappop(self.rows[free])
        if not self.rows[free]:
            self._set(free, 0)
        return free, row

    def _set(self, free: int, v: int) -> None:
        i = free + self.size
        self.tree[i] = v
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """The pieces of each row, in order of placement."""
    open_, rows = Capacities(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = open_.take(n)
        if got is None:
            rows.append([i])
            free, row = size, len(rows) - 1
        else:
            free, row = got
            rows[row].append(i)
        if free > n:
            open_.add(free - n, row)
    return rows


SCHEMA = (
    "bin_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW, pad: int = PAD, ranks_path: str = RANKS, window: int = WINDOW_TOKENS) -> DataFrame:
    """Rows of ``row_tokens`` ids: bin_id, n_tokens, n_segments, doc_ids and piece numbers of the segments,
    cu_seqlens (cumulative lengths, from 0), input_ids and position_ids (little-endian, 2 bytes if
    they fit, else 4), padded with ``pad`` and 0. Positions restart with every segment.

    Null and empty texts have no token and no segment. Null ids stay null. Repeated rows are packed
    once each. bin_id is unique: the task's partition number, then a count.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    id_type = np.dtype("<u2") if max(pad, ranks.count(b"\n")) < 1 << 16 else np.dtype("<u4")
    at_type = np.dtype("<u2") if row_tokens <= 1 << 16 else np.dtype("<u4")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(ranks)
        cache = SegmentCache(one_by_one(lambda b: enc.encode_ordinary(b.decode("utf-8", "replace"))))
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        total = 0

        def flush():
            nonlocal held, total, number
            lengths = np.array([len(p[2]) for p in held], np.int64)
            rows = best_fit_decreasing(lengths, row_tokens)
            for lo in range(0, len(rows), 256):
                out = [[] for _ in range(8)]
                for row in rows[lo : lo + 256]:
                    n = lengths[row]
                    ends = np.cumsum(n)
                    ids, pos = np.full(row_tokens, pad, id_type), np.zeros(row_tokens, at_type)
                    ids[: ends[-1]] = np.concatenate([held[i][2] for i in row])
                    pos[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - n, n)
                    values = (base + number, int(ends[-1]), len(row), [held[i][0] for i in row], [held[i][1] for i in row], [0, *ends.tolist()], ids.tobytes(), pos.tobytes())
                    number += 1
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
                names = ["bin_id", "n_tokens", "n_segments", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            held, total = [], 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, ids, at in text_ids(batch.column(1), cuts, cache):
                for i in range(lo, hi):
                    own = ids[at[i - lo] : at[i - lo + 1]]
                    for piece, x in enumerate(range(0, len(own), row_tokens)):
                        held.append((doc_ids[i], piece, own[x : x + row_tokens].astype(id_type)))
                    total += len(own)
                if total >= window:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, SCHEMA)


def write_packed(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet under ``path``; each id matrix is the concatenation of a file's input_ids."""
    rows.write.parquet(path)
