"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: of each SPAN consecutive word k-mers the one of least hash, so two texts that share
   K + SPAN - 1 words in a row share a seed; and each pair of neighbouring seeds. Pairs are rare where
   single seeds are common phrases, so phrases of other texts do not hide a passage.
2. Every occurrence of a seed or pair is joined to its first one (by id, then position), in the same
   text too: a seed of a thousand texts gives a thousand matches, not a million pairs. Seeds of very
   many occurrences are dealt to several tasks by text, and the first of each share is joined to the
   first of all.
3. The matches of a text with one other text are chained: best total of seed weights less GAP for each
   word skipped on either side, by prefix maxima in a Fenwick tree.
4. Chains are aligned on the words of both texts: the words between seeds are compared by edit
   distance, and both ends extended until the score has fallen by DROP below its best. A chain is seen
   with NEAR words around it first; where it goes on there and no other passage of its text takes over,
   it is seen with both whole texts. Chains below IDENTITY are left out.
5. Pieces that go on where another of the same two texts ends are one passage; passages of at least
   MIN_WORDS words are kept, each with its own source. One inside another of its text is left out.
6. Quotations hide passages: if all seeds of a passage, and all pairs, stand in pieces of earlier texts, the
   text that has it whole is never met. But then such pieces lie end to end over the passage, in either
   text. So stretches of MIN_WORDS words that pieces cover and no passage does are searched once more among
   themselves: the pieces' own texts have no such stretch and are out of the way. Here seeds, pairs
   and runs of RUN seeds meet their first occurrence and the one before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batch_rows, bloom, forget, free_name, in_arrow, in_bloom, written
from .words import Slice, mix, slices, window_hashes

K = 6
SPAN = 14
GAP = 0.1
IDENTITY = 0.8
MIN_PIECE = 12  # words of an aligned chain; extension has bridged what a shorter one could be part of
MIN_WORDS = 45
TOUCH = 6  # words between two pieces of one passage
OVERLAP = 12  # words that a passage shares with the one that takes over from it
MISMATCH = -2.0
DROP = 12.0
NEAR = 48
RUN = 4  # seeds in a row that are one more seed of a stretch
BETWEEN = 12  # words between two pieces of one stretch
WHOLE = 1 << 30
BUCKETS = 1 << 16  # of seed hashes, counted to find seeds of very many occurrences
BROADCAST_SPANS = 1_000_000  # spans of 16 bytes
ROWS = 1000  # rows of word arrays in one Arrow batch
HOT = 20_000  # occurrences in one bucket; more than this, and than four times the mean, are dealt to several tasks


def first_least(g: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` values in a row, the first of equals; the places never fall. Windows double, so it takes few passes."""
    at, size = np.arange(len(g), dtype=np.int32 if len(g) < 1 << 31 else np.int64), 1
    while size < span:
        step = min(size, span - size)
        at = np.where(g[step:] < g[:-step], at[step:], at[:-step])
        g = np.minimum(g[step:], g[:-step])
        size += step
    return at


def winnow(s, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the seeds of a slice."""
    h = window_hashes(s.hash, k)
    if not len(h):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    row = np.repeat(np.arange(s.hi - s.lo), s.counts())
    inside = row[: len(h)] == row[k - 1 :]
    top = np.iinfo(np.uint64).max
    g = np.concatenate([np.full(span - 1, top), np.where(inside, h, top), np.full(span - 1, top)])
    # A window belongs to one text: what lies beyond its ends is masked by the k-mers that cross them.
    pick = first_least(g, span)
    pick = pick[np.append(True, pick[1:] != pick[:-1])].astype(np.int64) - (span - 1)
    pick = pick[(pick >= 0) & (pick < len(h))]
    pick = pick[inside[pick]]
    return row[pick], pick - s.row[row[pick]], h[pick]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def _all_seeds(s, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the seeds of a slice and of their neighbouring pairs."""
    row, pos, h = winnow(s, k, span)
    if len(h) < 2:
        return row, pos, h
    both = np.flatnonzero(row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        pair = mix(h[both] * np.uint64(0x9E3779B97F4A7C15) + h[both + 1])
    return np.concatenate([row, row[both]]), np.concatenate([pos, pos[both]]), np.concatenate([h, pair])


def hot_buckets(docs: DataFrame, id_col: str, text_col: str, k: int, span: int, hot: int = HOT) -> np.ndarray:
    """The number of tasks that the seeds of each bucket are dealt to; exact counts, BUCKETS rows a task."""

    def run(batches):
        import pyarrow as pa

        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in slices(batch.column(1)):
                count += np.bincount((_all_seeds(s, k, span)[2] >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], ["bucket", "n"])

    counts = in_arrow(_texts(docs, id_col, text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    t = counts.toArrow()  # BUCKETS rows at most
    n = np.zeros(BUCKETS, np.int64)
    n[t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    limit = max(hot, 4 * int(n.mean()))
    return np.where(n > limit, -(-n // limit), 1).astype(np.int32)


def seeds(docs: DataFrame, parts: np.ndarray, id_col: str, text_col: str, k: int, span: int, only_hot: bool = False) -> DataFrame:
    """(seed, part, id, pos)"""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for s in slices(batch.column(1)):
                row, pos, h = _all_seeds(s, k, span)
                many = parts[(h >> np.uint64(48)).astype(np.int64)]
                if only_hot:
                    keep = many > 1
                    row, pos, h, many = row[keep], pos[keep], h[keep], many[keep]
                own = ids[s.lo : s.hi][row]
                part = np.zeros(len(own), np.int32)
                spread_ = np.flatnonzero(many > 1)
                part[spread_] = mix(own[spread_].view(np.uint64)) % many[spread_].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part), pa.array(own), pa.array(pos.astype(np.int32))], ["seed", "part", "id", "pos"])

    return in_arrow(_texts(docs, id_col, text_col), run, "seed long, part int, id long, pos int")


def _linked(occurrences: DataFrame, *keys: str) -> DataFrame:
    """(id, anchor, y, x): each occurrence with the first of its group."""
    w = Window.partitionBy(*keys).orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = occurrences.select("id", F.col("pos").alias("y"), F.first("id").over(w).alias("anchor"), F.first("pos").over(w).alias("x"))
    return rows.where("anchor < id or x < y").select("id", "anchor", "y", "x")


def _seeds_of_words(s, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of seeds, pairs and runs of RUN seeds."""
    row, pos, h = winnow(s, k, span)
    rows, places, keys = [row], [pos], [h]
    for n in (2, RUN):
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(h) >= n else np.zeros(0, np.int64)
        rows.append(row[at])
        places.append(pos[at])
        keys.append(window_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(keys)


def stretches(pieces: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(id, lo, hi): at least min_words words of a text that pieces cover end to end, without pieces inside a passage found."""
    rows = pieces.select("id", F.col("y0").alias("lo"), F.col("y1").alias("hi"), F.lit(0).alias("whole")).union(found.select("id", "y0", "y1", F.lit(1)))
    order = Window.partitionBy("id").orderBy(F.col("lo") - F.when(F.col("whole") == 1, BETWEEN).otherwise(0), F.col("whole").desc(), "hi")
    reach = F.max(F.when(F.col("whole") == 1, F.col("hi"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = rows.withColumn("reach", reach).where("whole = 0").where((F.col("hi") - BETWEEN > F.col("reach")) | F.col("reach").isNull()).select("id", "lo", "hi")
    order = Window.partitionBy("id").orderBy("lo", "hi")
    far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = left.withColumn("island", F.sum(F.when(F.col("lo") <= far + BETWEEN, 0).otherwise(1)).over(order))
    return left.groupBy("id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("hi") - F.col("lo") >= min_words).drop("island")


def hidden_matches(found: DataFrame, words: DataFrame, parts: np.ndarray, k: int, span: int) -> DataFrame:
    """(id, anchor, y, x): seeds of stretches with their first occurrence in stretches and the one before."""
    text = found.join(words, "id").select("id", "lo", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("w"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, lo, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            none = np.zeros(0, np.int64)
            row, pos, h = _seeds_of_words(Slice(0, len(ids), none, none, none, mix(flat.view(np.uint32).astype(np.uint64)), at - at[0], none), k, span)
            own = ids[row]
            part = (mix(own.view(np.uint64)) % parts[(h >> np.uint64(48)).astype(np.int64)].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part), pa.array(own), pa.array((pos + lo[row]).astype(np.int32))], ["seed", "part", "id", "pos"])

    rows = written(in_arrow(text, run, "seed long, part int, id long, pos int"), "stretch-seeds")
    w = Window.partitionBy("seed", "part").orderBy("id", "pos")
    before = rows.select("id", F.lag("id").over(w).alias("anchor"), F.col("pos").alias("y"), F.lag("pos").over(w).alias("x")).where("anchor is not null")
    heads = rows.groupBy("seed", "part").agg(F.min(F.struct("id", "pos")).alias("head")).select("seed", "head.*")
    return before.union(_linked(rows, "seed", "part")).union(_linked(heads, "seed")).where("anchor < id or x < y")


def matches_of(docs: DataFrame, parts: np.ndarray, id_col: str, text_col: str, k: int, span: int) -> DataFrame:
    links = _linked(seeds(docs, parts, id_col, text_col, k, span), "seed", "part")
    if (parts > 1).any():
        heads = seeds(docs, parts, id_col, text_col, k, span, only_hot=True).groupBy("seed", "part").agg(F.min(F.struct("id", "pos")).alias("head"))
        links = links.union(_linked(heads.select("seed", "head.*"), "seed"))
    return links


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, v: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if v > self.best[i]:
                self.best[i] = v
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """The largest among items 0 to i - 1."""
        out = (float("-inf"), -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, weight: float = float(K), gap: float = GAP) -> list[np.ndarray]:
    """Disjoint chains of matches (x_i, y_i), best first found; each increases in x and in y.

    score(i) = weight + max(0, max over j before i in x and in y of score(j) - gap * ((x_i - x_j) + (y_i - y_j))).
    With weights and costs alike for all, the gap cost splits into a part of i and one of j, so a prefix
    maximum over y finds the predecessor.
    """
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if n == 1 or (np.diff(x).min() > 0 and np.diff(y).min() > 0):  # collinear as a whole: only too wide gaps break it
        run = weight
        cut = []
        step = gap * (np.diff(x) + np.diff(y))
        for i, c in enumerate(step.tolist(), 1):
            if run - c <= 0:
                cut.append(i)
                run = 0.0
            else:
                run -= c
            run += weight
        return [order[p] for p in np.split(np.arange(n), cut)]
    rank = np.unique(y, return_inverse=True)[1].tolist()
    tree = Fenwick(max(rank) + 1)
    score, back = [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches of one x cannot follow each other
            v, p = tree.before(rank[j])
            v -= gap * (xs[j] + ys[j])
            score[j], back[j] = (weight + v, p) if v > 0 else (weight, -1)
            j += 1
        for m in range(i, j):
            tree.put(rank[m], (score[m] + gap * (xs[m] + ys[m]), m))
        i = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(order[np.array(path[::-1])])
    return out


CHAIN = "id long, anchor long, xs array<int>, ys array<int>"


def _chain_rows(t):
    """CHAIN rows of whole (id, anchor) groups of sorted matches."""
    import pyarrow as pa

    ids, anchors, y, x = (t.column(c).to_numpy() for c in ("id", "anchor", "y", "x"))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(anchors) != 0)
    keep = new.copy()
    keep[1:] |= (np.diff(y) != 0) | (np.diff(x) != 0)  # a seed and its pair may give one match
    ids, anchors, y, x, new = ids[keep], anchors[keep], y[keep], x[keep], new[keep]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ids)))
    alone = first[size == 1]
    where, lengths = [alone], [np.ones(len(alone), np.int64)]
    for lo, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        for c in chains(x[lo : lo + n].astype(np.int64), y[lo : lo + n].astype(np.int64)):
            where.append(lo + c)
            lengths.append(np.array([len(c)]))
    at, lengths = np.concatenate(where), np.concatenate(lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    head = at[bounds[:-1]]
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v[at])) for v in (x, y)]
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(anchors[head]), *lists], ["id", "anchor", "xs", "ys"])


def chained(matches: DataFrame) -> DataFrame:
    """(id, anchor, xs, ys) from (id, anchor, y, x) rows; one text's matches with one other are chained together."""

    def run(batches):
        import pyarrow as pa

        held = []
        for batch in batches:  # whole groups at a time: the last one may go on in the next batch
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            ids, anchors = t.column("id").to_numpy(), t.column("anchor").to_numpy()
            other = np.flatnonzero((ids != ids[-1]) | (anchors != anchors[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield _chain_rows(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield _chain_rows(pa.Table.from_batches(held).combine_chunks())

    return in_arrow(matches.repartition("id", "anchor").sortWithinPartitions("id", "anchor", "y", "x"), run, CHAIN)


def word_arrays(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, words): 32-bit word hashes of texts whose id may be in the filter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
            for s in slices(batch.column(1)):
                short = (s.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(s.row, pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), lists], ["id", "words"])

    return in_arrow(_texts(docs, id_col, text_col), run, "id long, words array<int>")


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance of two short runs."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    at = np.arange(len(b) + 1)
    row = at.copy()
    for x in a.tolist():
        best = np.empty_like(row)
        best[0] = row[0] + 1
        best[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(best - at) + at
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs go on alike, with mismatches at a cost, until the score is DROP below its best; and how many there are."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1.0, MISMATCH))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0.0)) - total > DROP)
    if len(low):
        total = total[: low[0]]
    k = int(total.argmax()) + 1 if len(total) else 0
    return (k, int(k - same[:k].sum())) if k and total[k - 1] > 0 else (0, 0)


def _extend_all(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_extend` by at most NEAR words for many runs at once; ``n`` words are there from at_a and at_b on, by ``step``."""
    t = np.arange(NEAR)
    there = t < n[:, None]
    same = a[np.clip(at_a[:, None] + step * t, 0, max(0, len(a) - 1))] == b[np.clip(at_b[:, None] + step * t, 0, max(0, len(b) - 1))]
    total = np.cumsum(np.where(there, np.where(same, np.float32(1), np.float32(MISMATCH)), np.float32(0)), axis=1, dtype=np.float32)
    low = np.maximum.accumulate(np.maximum(total, 0), axis=1) - total > DROP
    gone = low.any(axis=1)
    total[np.logical_or.accumulate(low, axis=1)] = -np.inf
    k = total.argmax(axis=1) + 1
    k[total[np.arange(len(k)), k - 1] <= 0] = 0
    return k, ((there & ~same) & (t < k[:, None])).sum(axis=1), ~gone


def parted(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(first seed, last seed, edits between) of the parts of a chain, which is cut where the edits between two seeds cost more than DROP."""
    first, edits, parts = 0, 0, []
    shift = x - y
    runs = [0, *(np.flatnonzero(np.diff(shift)) + 1).tolist(), len(x)]

    def gap(i):
        nonlocal first, edits
        x0, y0, x1, y1 = int(x[i]) + k, int(y[i]) + k, int(x[i + 1]), int(y[i + 1])
        over = max(0, x0 - x1, y0 - y1)  # overlapping seeds: compare from where both are past
        p, q = a[min(x0, x1) : x1], b[min(y0, y1) : y1]
        step = abs(len(p) - len(q)) if over else _distance(p, q)
        if -MISMATCH * step > DROP:
            parts.append((first, i, edits))
            first, edits = i + 1, 0
        else:
            edits += step

    for lo, hi in zip(runs, runs[1:], strict=False):
        if lo:
            gap(lo - 1)
        if hi - lo > 1:  # seeds side by side in both texts: only the gaps with a difference matter
            apart = np.flatnonzero(a[x[lo] : x[hi - 1]] != b[y[lo] : y[hi - 1]])
            for i in np.unique(np.searchsorted(x[lo:hi] - x[lo], apart, side="right") - 1).tolist():
                gap(lo + i)
    return [*parts, (first, len(x) - 1, edits)]


#: Of a part: bounds of its seeds in the text (y) and its anchor (x), edits between them, words and edits of both extensions, and whether these may go on.
PIECE = "id long, anchor long, y0 int, y1 int, x0 int, x1 int, mid int, kl int, el int, kr int, er int, on_left boolean, on_right boolean"


def aligned(found: DataFrame, words: DataFrame, k: int, identity: float) -> DataFrame:
    """PIECE rows: parts of chains with MIN_PIECE words at least and ``identity``, seen with NEAR words around them; and all that may go on beyond."""
    near = NEAR
    back = F.least(F.element_at("xs", 1), F.element_at("ys", 1), F.lit(near))  # to the left no further than both texts go
    found = found.withColumns({c: F.element_at(v, 1) - back for c, v in (("xo", "xs"), ("yo", "ys"))})
    size = lambda v, o: F.element_at(v, -1) - F.col(o) + F.lit(k + near)
    b = found.join(words, "id").withColumn("b", F.slice("words", F.col("yo") + 1, size("ys", "yo"))).drop("words")
    both = b.join(words.withColumnRenamed("id", "anchor"), "anchor").withColumn("a", F.slice("words", F.col("xo") + 1, size("xs", "xo")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, anchors, xo, yo = (batch.column(c).to_numpy() for c in ("id", "anchor", "xo", "yo"))
            (av, ao), (bv, bo), (xv, so), (yv, so_y) = ((batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy().astype(np.int64)) for c in ("a", "b", "xs", "ys"))
            chain, parts = [], []
            many = np.diff(so)
            for c in np.flatnonzero(many > 1).tolist():
                for part in parted(av[ao[c] : ao[c + 1]], bv[bo[c] : bo[c + 1]], xv[so[c] : so[c + 1]] - xo[c], yv[so_y[c] : so_y[c + 1]] - yo[c], k):
                    chain.append(c)
                    parts.append(part)
            alone = np.flatnonzero(many == 1)
            c = np.concatenate([alone, np.array(chain, np.int64)])
            i0, i1, edits = (np.concatenate([np.zeros(len(alone), np.int64), np.array([p[j] for p in parts], np.int64)]) for j in range(3))
            if not len(c):
                continue
            at = lambda v, o, i, off: v[o[c] + i].astype(np.int64) - off[c]  # noqa: E731  a seed's place in the words at hand
            x0, x1, y0, y1 = at(xv, so, i0, xo), at(xv, so, i1, xo) + k, at(yv, so_y, i0, yo), at(yv, so_y, i1, yo) + k
            la, lb = np.diff(ao)[c], np.diff(bo)[c]
            left, right = np.minimum(x0, y0), np.minimum(la - x1, lb - y1)
            kl, el, more_l = _extend_all(av, ao[c] + x0 - 1, bv, bo[c] + y0 - 1, left, -1)
            kr, er, more_r = _extend_all(av, ao[c] + x1, bv, bo[c] + y1, right, 1)
            # Where the score holds to the end of what was looked at, it may go on if both texts do.
            more_l &= (left > NEAR) | (np.minimum(xo, yo)[c] > 0)
            last = so[1:][c] - 1 - so[:-1][c]
            more_r &= (right > NEAR) | (np.minimum(la - at(xv, so, last, xo), lb - at(yv, so_y, last, yo)) >= k + near)
            size_ = np.maximum(x1 - x0, y1 - y0) + kl + kr
            keep = np.flatnonzero(more_l | more_r | (y1 - y0 + kl + kr >= MIN_PIECE) & (edits + el + er <= (1 - identity) * size_))
            c = c[keep]
            plain = (y0[keep] + yo[c], y1[keep] + yo[c], x0[keep] + xo[c], x1[keep] + xo[c], *(v[keep] for v in (edits, kl, el, kr, er)))
            cols = [pa.array(ids[c]), pa.array(anchors[c]), *(pa.array(v.astype(np.int32)) for v in plain), pa.array(more_l[keep]), pa.array(more_r[keep])]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PIECE.split(", ")])

    return in_arrow(both.select("id", "anchor", "a", "b", "xs", "ys", "xo", "yo"), run, PIECE)


def _bounds(pieces: DataFrame) -> DataFrame:
    """Adds start, end (in the text), from_, to (in the anchor) and edits of the whole piece."""
    return pieces.withColumns({
        "start": F.col("y0") - F.col("kl"), "end": F.col("y1") + F.col("kr"), "from_": F.col("x0") - F.col("kl"), "to": F.col("x1") + F.col("kr"), "edits": F.expr("mid + el + er"),
    })


def carried_on(pieces: DataFrame, identity: float, min_words: int) -> DataFrame:
    """PIECE rows whose on_left and on_right hold only where no passage of the text takes over with OVERLAP words in common."""
    rows = _bounds(pieces)
    fit = (F.col("end") - F.col("start") >= min_words) & (F.col("edits") <= (1 - identity) * F.greatest(F.col("end") - F.col("start"), F.col("to") - F.col("from_")))
    rows = rows.withColumn("fit", fit)
    order = Window.partitionBy("id", "fit").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum(F.when(F.col("start") > far - OVERLAP, 1).otherwise(0)).over(order))
    whole = Window.partitionBy("id", "fit", "island")
    rows = rows.withColumns({"first": F.min("start").over(whole), "last": F.max("end").over(whole)})
    rows = rows.withColumns({"on_left": F.col("on_left") & (~F.col("fit") | (F.col("start") == F.col("first"))), "on_right": F.col("on_right") & (~F.col("fit") | (F.col("end") == F.col("last")))})
    return rows.select(*pieces.columns)


def extended(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """The pieces with the ends that may go on extended over both whole texts."""
    back = F.when(F.col("on_left"), F.least("x0", "y0")).otherwise(0)
    after = F.when(F.col("on_right"), F.lit(WHOLE)).otherwise(0)
    cut = lambda v, lo, hi: (F.slice("words", F.col(lo) - back + 1, back).alias(v + "l"), F.slice("words", F.col(hi) + 1, after).alias(v + "r"))
    names = pieces.columns
    b = pieces.join(words, "id").select(*names, *cut("b", "y0", "y1"))
    both = b.join(words.withColumnRenamed("id", "anchor"), "anchor").select(*names, "bl", "br", *cut("a", "x0", "x1"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("kl", "el", "kr", "er", "on_left", "on_right")}
            text = {c: (batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy()) for c in ("al", "ar", "bl", "br")}
            part = lambda c, i: text[c][0][text[c][1][i] : text[c][1][i + 1]]
            for i in range(batch.num_rows):
                if col["on_left"][i]:
                    col["kl"][i], col["el"][i] = _extend(part("al", i)[::-1], part("bl", i)[::-1])
                if col["on_right"][i]:
                    col["kr"][i], col["er"][i] = _extend(part("ar", i), part("br", i))
            yield pa.RecordBatch.from_arrays([pa.array(col[c]) if c in col else batch.column(c) for c in names], names)

    return in_arrow(both, run, PIECE)


def passages_of(pieces: DataFrame, min_words: int) -> DataFrame:
    """(id, anchor, y0, y1, x0, x1, edits): pieces of the same two texts, each going on where one before ends in both, are one passage."""
    order = Window.partitionBy("id", "anchor").orderBy("y0", "y1", "x0")
    gap = F.col("y0") - F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.col("x0") - F.col("y0")) - F.lag(F.col("x1") - F.col("y1")).over(order)
    new = F.coalesce((gap > TOUCH) | (F.abs(shift) > TOUCH), F.lit(True))
    return (
        pieces.withColumns({"new": new.cast("int"), "between": F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0))})
        .withColumn("island", F.sum("new").over(order)).withColumn("edits", F.col("edits") + F.when(F.col("new") == 0, F.col("between")).otherwise(0))
        .groupBy("id", "anchor", "island").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("edits").alias("edits"))
        .where(F.col("y1") - F.col("y0") >= min_words).drop("island")
    )


def _longest(spans: DataFrame) -> DataFrame:
    """Of the spans (id, lo, hi, source, edits) of a text from one word, the longest, of the least source."""
    top = F.max(F.struct("hi", (-F.col("source")).alias("s"), (-F.col("edits")).alias("e"))).alias("m")
    return spans.groupBy("id", "lo").agg(top).select("id", "lo", F.col("m.hi").alias("hi"), (-F.col("m.s")).alias("source"), (-F.col("m.e")).alias("edits"))


def pieces_of(linked: DataFrame, words: DataFrame, k: int, identity: float, min_words: int) -> DataFrame:
    """(id, anchor, y0, y1, x0, x1, edits): the chains, aligned and extended at both ends."""
    spark = linked.sparkSession
    with batch_rows(spark, ROWS):
        near = written(aligned(linked, words, k, identity), "near")
    marked = written(carried_on(near, identity, min_words), "near")
    forget(near)
    with batch_rows(spark, ROWS // 4):
        far = written(extended(marked.where("on_left or on_right"), words), "far")
    pieces = _bounds(marked.where("not (on_left or on_right)").union(far)).select("id", "anchor", F.col("start").alias("y0"), F.col("end").alias("y1"), F.col("from_").alias("x0"), F.col("to").alias("x1"), "edits")
    return pieces.where((F.col("y1") - F.col("y0") >= MIN_PIECE) & (F.col("edits") <= (1 - identity) * F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, span: int = SPAN, identity: float = IDENTITY, min_words: int = MIN_WORDS, first: bool = True, hot: int = HOT) -> DataFrame:
    """id, start_word, end_word, n_words, source_id, edits, is_first for each passage that occurs earlier: in a text of smaller id, or further up.

    Word positions count from 0; end_word is exclusive. With ``first`` the earlier occurrences that
    are not repeats themselves are returned too (source_id = their own id). Case of A-Z is ignored.
    Null ids, null texts and texts of fewer than ``k`` words have no passage; rows that share an id
    count as one text, so ids should be unique. Other columns are ignored; an empty table gives an
    empty result. Of spans that start at one word the longest is given, of the least source.
    """
    spark = docs.sparkSession
    parts = hot_buckets(docs, id_col, text_col, k, span, hot)
    linked = written(chained(matches_of(docs, parts, id_col, text_col, k, span)), "chains")
    words = written(word_arrays(docs, bloom(linked.select("id").union(linked.select("anchor")), "id"), id_col, text_col), "words")
    pieces = written(pieces_of(linked, words, k, identity, min_words), "pieces")
    forget(linked)
    found = written(passages_of(pieces, min_words), "passages")
    hidden = written(stretches(pieces, found, min_words), "stretches")
    if hidden.limit(1).count():
        linked = written(chained(hidden_matches(hidden, words, parts, k, span)), "chains")
        more = written(pieces_of(linked, words, k, identity, min_words), "pieces")
        forget(linked)
        found = written(passages_of(pieces.union(more).distinct(), min_words), "passages")
        forget(more)
    forget(hidden)
    forget(pieces)
    forget(words)
    spans = _longest(found.select("id", F.col("y0").alias("lo"), F.col("y1").alias("hi"), F.col("anchor").alias("source"), "edits")).withColumn("is_first", F.lit(False))
    if first:
        there = found.where("anchor <> id or x1 <= y0").select(F.col("anchor").alias("id"), F.col("x0").alias("lo"), F.col("x1").alias("hi"), F.col("anchor").alias("source"), "edits")
        spans = spans.union(_longest(there).withColumn("is_first", F.lit(True)))
    w = Window.partitionBy("id").orderBy(F.col("lo") + F.when(F.col("is_first"), TOUCH).otherwise(0), F.col("is_first"), F.col("hi").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda kind: F.coalesce(F.max(F.when(F.col("is_first") == kind, F.col("hi"))).over(w), F.lit(0))
    inside = F.when(F.col("is_first"), (reach(False) + TOUCH >= F.col("hi")) | (reach(True) >= F.col("hi"))).otherwise(reach(False) >= F.col("hi"))
    out = spans.withColumn("inside", inside).where("not inside")
    return out.select(F.col("id").alias(id_col), F.col("lo").cast("long").alias("start_word"), F.col("hi").cast("long").alias("end_word"), (F.col("hi") - F.col("lo")).cast("long").alias("n_words"), F.col("source").alias("source_id"), F.col("edits").cast("long").alias("edits"), "is_first")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with each passage cut out of all texts but its first; a text that has no word left goes.

    Texts without such a passage stay byte for byte, as do rows with a null id. An empty table stays
    empty. Other columns of docs may have any name.
    """
    sid, cuts = free_name(docs, "_sid"), free_name(docs, "_spans")
    spans = repeated_passages(docs, id_col, text_col, first=False, **kw).groupBy(F.col(id_col).alias(sid)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    spans = written(spans, "spans")
    few = (spans.agg(F.sum(F.size(cuts) + 2)).first()[0] or 0) <= BROADCAST_SPANS
    rows = docs.join(F.broadcast(spans) if few else spans, F.col(id_col) == F.col(sid), "left").drop(sid)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            spans_, text = batch.column(len(schema)), batch.column(at)
            if spans_.null_count == len(spans_):
                yield batch.drop_columns([cuts])
                continue
            out, keep = text.to_pylist(), np.ones(len(text), bool)
            given = spans_.to_pylist()
            for s in slices(text, limit=1 << 20):
                for i in range(s.lo, s.hi):
                    if not given[i]:
                        continue
                    a, b = s.row[i - s.lo], s.row[i - s.lo + 1]
                    raw = s.buf[s.bytes_at[i - s.lo] : s.bytes_at[i - s.lo + 1]].tobytes()
                    base, parts, pos = s.bytes_at[i - s.lo], [], 0
                    for g in given[i]:  # in order; they may overlap
                        lo, hi = int(g["start_word"]), min(int(g["end_word"]), int(b - a))
                        if lo >= hi:
                            continue
                        parts.append(raw[pos : max(pos, int(s.start[a + lo] - base))])
                        pos = max(pos, int(s.start[a + hi] - base) if a + hi < b else len(raw))
                    out[i] = (b"".join(parts) + raw[pos:]).decode("utf-8", "replace")
                    keep[i] = bool(out[i].strip(" \t\n\v\f\r"))
            cols = [pa.array(out, text.type) if j == at else batch.column(j) for j in range(len(schema))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names).filter(pa.array(keep))

    return rows.select(*docs.columns, cuts).transform(in_arrow, run, schema)
