"""The trie of conversation prefixes, from sorted sequences and their longest common prefixes.

A conversation is the sequence of its turns' keys. All sequences are sorted and dealt by range to parts of
bounded size (copies are told apart by conv_id, so no key fills a part). The members of a node are then one
interval of the order: a part holds a sparse table of range minima over the common prefixes of neighbours, and
each candidate prefix searches its left and its right end there, on its own, by halving steps. An interval that
leaves its part goes on over a second sparse table, of one minimum for each part; the tables of the parts, a few
numbers for each depth shared across a border, are all that the driver sees. Nodes come in preorder, so sums over
subtrees are differences of running sums; what a node holds in later parts is added by a join.

Rows without conv_id are left out. Turns are ordered by turn (null first), then role and text; null role or text
is empty; repeated rows are turns of their own. A table without conversations has no nodes, not even the root.
Other columns are not read. One row holds the keys (16 bytes a turn) of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_text, in_arrow, small, written
from .words import spread

PART_TURNS = 1 << 19  # turns of a part, about
FAMILY = 100  # conversations that share the opening of their first one
OPENING = 6  # an opening has fewer turns
KEY_BYTES = 16
FAR = (1 << 62) - 1
_NONE = hashlib.sha256(b"").hexdigest()


# ---- sequences ----------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars): turns in order from 1, with a hash of role and text and the text's code points."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty_text(F.col("role")).alias("role"), empty_text(F.col("text")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), key.alias("key"), F.length("text").cast("long").alias("chars"))


def grafted(turns: DataFrame) -> DataFrame:
    """Turns of each conversation c after its opening, behind the first h = crc32(c) mod OPENING turns of c - c mod FAMILY.

    A conversation that is left without turns has one row without key.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), h.alias("h"))
    opening = turns.where(F.col("pos") < OPENING).withColumnRenamed("conv_id", "first")
    head = ids.join(opening, "first").where("pos <= h").select("conv_id", F.lit(0).alias("side"), "pos", "key", "chars")
    tail = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("side"), "pos", "key", "chars")
    none = ids.select("conv_id", F.lit(2).alias("side"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("chars"))
    return head.unionByName(tail).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, chars): the joined keys of a conversation's turns, by (side, pos), and their code points."""
    turn = F.when(F.col("key").isNotNull(), F.struct("side", "pos", "key", "chars"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.col("t.key"), "")).alias("key"), F.col("t.chars").alias("chars"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    return sequences(grafted(written(ordered_turns(conversations), "trie-turns")))


# ---- range minima -------------------------------------------------------------------------------


class RangeMin:
    """A sparse table: row k has the minima of 2^k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.n, self.rows = len(values), [values]
        while 2 << (len(self.rows) - 1) <= self.n:
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of the places lo to hi - 1, none of them empty."""
        out = np.empty(len(lo), dtype=self.rows[0].dtype)
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(power):
            at = power == k
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k)])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind ``at`` are at least ``bound``."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            fits = np.flatnonzero(at + (1 << k) < self.n)
            fits = fits[self.rows[k][at[fits] + 1] >= bound[fits]]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from behind which on, to ``at``, all values are at least ``bound``."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            fits = np.flatnonzero(at - (1 << k) >= 0)
            fits = fits[self.rows[k][at[fits] - (1 << k) + 1] >= bound[fits]]
            at[fits] -= 1 << k
        return at


# ---- parts --------------------------------------------------------------------------------------


class Part:
    """Sorted sequences with the common prefix of each and the one before it (that of the first is 0 here)."""

    def __init__(self, batches):
        table = pa.Table.from_batches(batches).sort_by([("key", "ascending"), ("conv_id", "ascending")]).combine_chunks()
        key = table.column("key").combine_chunks().cast(pa.large_binary())
        self.key, self.conv = key, table.column("conv_id").to_numpy()
        at = np.frombuffer(key.buffers()[1], dtype=np.int64)[key.offset : key.offset + len(key) + 1]
        data = key.buffers()[2]
        words = np.frombuffer(data, dtype=np.uint64, count=2 * int(at[-1] // KEY_BYTES)).reshape(-1, 2) if data is not None else np.zeros((0, 2), dtype=np.uint64)
        self.at = at // KEY_BYTES
        self.size = np.diff(self.at)
        self.lcp = np.zeros(len(self.conv), dtype=np.int64)
        both = np.minimum(self.size[1:], self.size[:-1])
        a, b = spread(self.at[:-2], both), spread(self.at[1:-1], both)
        unlike = np.where((words[a] != words[b]).any(1), spread(np.zeros_like(both), both), FAR)
        some = both > 0
        first = np.cumsum(both) - both
        self.lcp[1:][some] = np.minimum(np.minimum.reduceat(unlike, first[some]), both[some]) if some.any() else 0
        chars = table.column("chars").combine_chunks()
        self.chars = chars.flatten().to_numpy(zero_copy_only=False)

    def runs(self):
        """Steps (bound, rows, least conv_id, turns of the last row) of the rows from either end that share so many turns."""
        out = []
        for lcp, conv, size in ((self.lcp[1:], self.conv, self.size), (self.lcp[:0:-1], self.conv[::-1], self.size[::-1])):
            low, conv = np.minimum.accumulate(lcp), np.minimum.accumulate(conv)
            last = np.flatnonzero(np.append(low[1:] != low[:-1], True)) if len(low) else np.zeros(0, dtype=np.int64)
            out.append([np.append(FAR, low[last]), np.append(1, last + 2), np.append(conv[0], conv[last + 1]), np.append(size[0], size[last + 1])])
        return out


_SUMMARY = "part int, n long, conv long, least long, first binary, last binary, head array<array<long>>, tail array<array<long>>"


def _summary_task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = Part(batches)
    head, tail = p.runs()
    yield pa.RecordBatch.from_pylist(
        [{"part": key[0].as_py(), "n": len(p.conv), "conv": int(p.conv.min()), "least": int(p.lcp[1:].min(initial=FAR)), "first": p.key[0].as_py(), "last": p.key[len(p.conv) - 1].as_py(), "head": [x.tolist() for x in head], "tail": [x.tolist() for x in tail]}],
        pa.schema([("part", pa.int32()), ("n", pa.int64()), ("conv", pa.int64()), ("least", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("head", pa.list_(pa.list_(pa.int64()))), ("tail", pa.list_(pa.list_(pa.int64())))]),
    )


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY_BYTES
    x, y = (np.frombuffer(k, dtype=np.uint64, count=2 * n).reshape(-1, 2) for k in (a, b))
    unlike = np.flatnonzero((x != y).any(1))
    return int(unlike[0]) if len(unlike) else n


class Parts:
    """The order of all parts: where each begins, what it shares with the one before, and its runs from either end."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["part"])
        self.index = {r["part"]: i for i, r in enumerate(rows)}
        self.start = np.concatenate([[0], np.cumsum([r["n"] for r in rows])]).astype(np.int64)
        self.border = np.array([-1] + [shared_turns(a["last"], b["first"]) for a, b in zip(rows, rows[1:])], dtype=np.int64)
        self.last = [len(r["last"]) // KEY_BYTES for r in rows]
        self.joined = [False] + [a["last"] == b["first"] for a, b in zip(rows, rows[1:])] + [False]
        # of the runs, only what is shared across a border can be asked for
        self.head = [self._cut(r["head"], self.border[i]) for i, r in enumerate(rows)]
        self.tail = [self._cut(r["tail"], self.border[i + 1] if i + 1 < len(rows) else -1) for i, r in enumerate(rows)]
        self.low = RangeMin(np.minimum(self.border, [r["least"] for r in rows]))
        self.conv = RangeMin(np.array([r["conv"] for r in rows], dtype=np.int64))

    @staticmethod
    def _cut(run, depth):
        bound, *rest = (np.array(x, dtype=np.int64) for x in run)
        # of the steps at or beyond depth only the longest is needed
        keep = slice(max(0, int(np.sum(bound >= depth)) - 1), None)
        return [bound[keep], *(x[keep] for x in rest)]

    @staticmethod
    def _step(run, depth):
        return [x[int(np.sum(run[0] >= depth)) - 1] for x in run[1:]]

    def _conv(self, lo, hi):
        return int(self.conv.least(np.array([lo]), np.array([hi]))[0]) if lo < hi else FAR

    def right(self, p: int, depth: int) -> tuple[int, int, int, int]:
        """(end, least conv_id behind part p, turns of the last row, last part) of a prefix that the last row of p has."""
        q = int(self.low.right(np.array([p]), np.array([depth]))[0])
        end, conv, last = int(self.start[q + 1]), self._conv(p + 1, q + 1), self.last[q]
        if q + 1 < len(self.border) and self.border[q + 1] >= depth:
            rows, least, last = self._step(self.head[q + 1], depth)
            q, end, conv = q + 1, end + int(rows), min(conv, int(least))
        return end, conv, int(last), q

    def left(self, p: int, depth: int) -> tuple[int, int]:
        """(begin, least conv_id before part p) of a prefix that the first row of p has."""
        if self.border[p] < depth:
            return int(self.start[p]), FAR
        q = int(self.low.left(np.array([p - 1]), np.array([depth]))[0])
        rows, least, _ = self._step(self.tail[q], depth)
        return int(self.start[q + 1] - rows), min(self._conv(q + 1, p), int(least))


_NODES = "kind string, part long, upto long, pos long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string"
_FIELDS = [f.split()[0] for f in _NODES.split(", ")]


def _rows(kind: str, n: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.string(), "ends_sha256": pa.string(), "ids": pa.string()}
    arrays = []
    for name in _FIELDS:
        kind_of = types.get(name, pa.int64())
        given = [kind] * n if name == "kind" else columns.get(name)
        arrays.append(given if isinstance(given, pa.Array) else pa.nulls(n, kind_of) if given is None else pa.array(given, kind_of))
    return pa.RecordBatch.from_arrays(arrays, _FIELDS)


def _by_depth(depths: np.ndarray, find) -> list[np.ndarray]:
    """The results of ``find(depth)``, once for each depth, as columns beside ``depths``."""
    each, at = np.unique(depths, return_inverse=True)
    found = np.array([find(int(d)) for d in each], dtype=np.int64).reshape(len(each), -1)
    return [found[at, k] for k in range(found.shape[1])]


def part_nodes(part: Part, p: int, parts: Parts) -> Iterator[pa.RecordBatch]:
    """The nodes whose first member is in this part, in preorder; its share of nodes of earlier parts; ids of ends that cross a border."""
    n, start = len(part.conv), int(parts.start[p])
    prefix, conv = RangeMin(part.lcp), RangeMin(part.conv)
    before = part.lcp.copy()
    before[0] = parts.border[p]
    count = part.size - before  # a row opens the nodes deeper than what it shares with the row before
    row, depth = np.repeat(np.arange(n), count), spread(before + 1, count)
    first = np.concatenate([[0], np.cumsum(count)])

    def extent(depth):
        lo, hi = prefix.left(row, depth), prefix.right(row, depth)
        least, begin, end = conv.least(lo, hi + 1), start + lo, start + hi + 1
        last, upto = part.size[hi], np.full(len(lo), p)
        out = np.flatnonzero(hi == n - 1)
        if len(out):
            e, c, t, q = _by_depth(depth[out], lambda d: parts.right(p, d))
            end[out], least[out], last[out], upto[out] = e, np.minimum(least[out], c), t, q
        out = np.flatnonzero(lo == 0)
        if len(out):
            b, c = _by_depth(depth[out], lambda d: parts.left(p, d))
            begin[out], least[out] = b, np.minimum(least[out], c)
        return hi, begin, end, least, last, upto

    hi, begin, end, least, last, upto = extent(depth)
    parent = extent(np.maximum(depth - 1, 0))[3]
    members = end - begin
    at = np.maximum(part.at[row] + depth - 1, 0)
    chars = np.where(depth > 0, part.chars[np.minimum(at, max(0, len(part.chars) - 1))], 0) if len(part.chars) else np.zeros(len(row), dtype=np.int64)
    saved = np.concatenate([[0], np.cumsum((members - 1) * chars)])
    leaves = np.concatenate([[0], np.cumsum(last == depth)])
    k, stop = np.arange(len(row)), first[hi + 1]
    width = len(row) + 1
    levels = np.sort(depth * width + k)

    def opened(depth, lo, hi):
        """How many nodes of that depth are among the nodes lo to hi - 1."""
        return np.searchsorted(levels, depth * width + hi) - np.searchsorted(levels, depth * width + lo)

    same = np.append(True, (part.lcp[1:] != part.size[1:]) | (part.size[1:] != part.size[:-1]))  # a new sequence begins
    heads = np.flatnonzero(same)
    tails = np.append(heads[1:], n)
    ids = lambda lo, hi: ",".join(map(str, part.conv[lo:hi].tolist()))
    sha = np.full(len(row), _NONE, dtype=object)
    whole = np.flatnonzero(depth == part.size[row])
    for i, b in zip(whole.tolist(), tails[np.searchsorted(heads, row[whole])].tolist(), strict=True):
        sha[i] = None if b == n and parts.joined[p + 1] else hashlib.sha256(ids(int(row[i]), b).encode()).hexdigest()
    step = 1 << 16
    for lo in range(0, len(row), step):
        s = slice(lo, lo + step)
        yield _rows(
            "node", len(row[s]), part=np.full(len(row[s]), p), upto=upto[s], pos=begin[s], depth=depth[s], conv_id=least[s],
            parent_conv_id=pa.array(parent[s], mask=depth[s] == 0), n_convs=members[s], n_children=opened(depth[s] + 1, k[s] + 1, stop[s]),
            n_leaves=leaves[stop[s]] - leaves[k[s]], saved_tokens=saved[stop[s]] - saved[k[s]], ends_sha256=sha[s].tolist(),
        )
    if p:
        shared = np.arange(parts.border[p] + 1)
        stop = first[prefix.right(np.zeros_like(shared), shared) + 1]
        yield _rows("run", len(shared), part=np.full(len(shared), p), depth=shared, n_children=opened(shared + 1, np.zeros_like(stop), stop), n_leaves=leaves[stop], saved_tokens=saved[stop])
    crossing = {(0, int(tails[0]))} if parts.joined[p] else set()
    if parts.joined[p + 1]:
        crossing.add((int(heads[-1]), n))
    for lo, hi in crossing:
        turns = int(part.size[lo])
        where = parts.left(p, turns)[0] if lo == 0 else start + lo
        yield _rows("ids", 1, part=[p], pos=[where], depth=[turns], ids=[ids(lo, hi)])


def _digests(batches):
    """Digests of texts that come in pieces, sorted by key: one state at a time, whatever the number of pieces."""
    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["pos", "depth", "digest"])

    for batch in batches:
        for pos, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("pos", "depth", "ids")), strict=True):
            if (pos, depth) != now:
                if now is not None:
                    yield row()
                now, state = (pos, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now is not None:
        yield row()


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each distinct prefix.

    ``sequences`` has conv_id (each once), key and chars, as :func:`sequences` makes them.
    """
    spark = sequences.sparkSession
    rows = written(sequences.select("conv_id", "key", "chars"), "trie-sequences")
    turns = rows.agg(F.sum(F.size("chars"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    dealt = written(rows.repartitionByRange(n, "key", "conv_id").withColumn("part", F.spark_partition_id()), "trie-parts")
    parts = Parts(dealt.groupBy("part").applyInArrow(_summary_task, _SUMMARY).toArrow().to_pylist())

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from part_nodes(Part(batches), parts.index[key[0].as_py()], parts)

    out = written(dealt.groupBy("part").applyInArrow(task, _NODES), "trie-nodes")
    nodes = out.where("kind = 'node'").drop("kind", "ids")
    last = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed, crossing = nodes.where("upto = part").select(last), nodes.where("upto > part")
    sums = ["n_children", "n_leaves", "saved_tokens"]
    share = out.where("kind = 'run'").select("part", "depth", *(F.col(c).alias(f"_{c}") for c in sums))
    share = crossing.select("pos", "depth", F.explode(F.sequence(F.col("part") + 1, F.col("upto"))).alias("part")).join(small(share), ["part", "depth"])
    share = share.groupBy("pos", "depth").agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in sums))
    pieces = out.where("kind = 'ids'").select("pos", "depth", "part", "ids").repartition("pos", "depth").sortWithinPartitions("pos", "depth", "part")
    digest = in_arrow(pieces, _digests, "pos long, depth long, digest string")
    crossing = crossing.join(share, ["pos", "depth"]).join(digest, ["pos", "depth"], "left")
    crossing = crossing.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).withColumn("ends_sha256", F.coalesce("ends_sha256", "digest"))
    return closed.union(crossing.select(last))
