"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

The CGK random walk copies a word sequence into a longer one: at step j it emits the current word and
moves on if a random bit of (j, word) is set. Two sequences at edit distance d come out at a Hamming
distance that depends on d alone, with good probability. Each of a number of walks is sampled at
SAMPLES steps; windows and items that agree on all samples of a walk are candidates. Each size class
has as many walks as find a pair at the edit limit with probability RECALL (REPEATS at least), by the
chance of one walk as it was simulated.

Windows have about an item's number of words and start at every word. The one that starts where the
passage does has at least m - 1 - 2 d - max(0, m - size) of the item's word pairs: each edit breaks
two at most, or moves one past the window's end. Windows with fewer pairs known to the benchmark than
the least of this over the lengths of their class are passed over; that loses no passage.
Candidates are verified by the exact word edit distance between the item and its best window, unless more
of the item's words are missing around the window than edits are allowed, which rules it out beforehand.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bloom, free_name, in_arrow, in_bloom, small, written
from .words import mix, slices

MAX_EDIT_PERCENT = 20
REPEATS = 24
SAMPLES = 5
RECALL = 0.99
#: The simulated chance that one walk of 5 samples agrees with any window within 6 words of a passage at 20 % random edits, by size.
WALK_SIZE, WALK_CHANCE = (6, 16, 32, 64, 128, 256), (0.456, 0.277, 0.215, 0.139, 0.076, 0.042)
WALK_MARGIN = 0.8  # as walks over one passage are not independent, and items differ from their window's size
RUN = 8  # starts of which one hit is checked for all
SIZES = 1.12  # windows of one size serve items up to this many times as long
MIN_ITEM = 4
BROADCAST_HASHES = 4_000_000  # words and keys of all items together, 32 MB; beyond it the same joins go by shuffle


def size_class(m: np.ndarray) -> np.ndarray:
    """The window size for items of m words."""
    m = np.maximum(np.asarray(m), 1)
    return np.maximum(1, np.round(SIZES ** np.round(np.log(m) / math.log(SIZES)))).astype(np.int64)


def allowed(m, percent: int = MAX_EDIT_PERCENT):
    """Edits that an item of m words may differ by."""
    return m * percent // 100


def walks(size: int, least: int = REPEATS, recall: float = RECALL) -> int:
    """The number of walks that windows of ``size`` words need; beyond the simulated sizes the chance falls on as between the last two."""
    x, y = np.log(WALK_SIZE), np.log(WALK_CHANCE)
    at = math.log(size)
    chance = float(np.interp(at, x, y)) if at <= x[-1] else y[-1] + (at - x[-1]) * (y[-1] - y[-2]) / (x[-1] - x[-2])
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - WALK_MARGIN * math.exp(chance))))


def pairs_needed(size: int, least: int, most: int, percent: int) -> int:
    """Word pairs of an item that the window of ``size`` words at a passage's start has, for any item of ``least`` to ``most`` words."""
    return max(0, min(m - 1 - 2 * int(allowed(m, percent)) - max(0, m - size) for m in range(least, most + 1)))


def plan(repeats: int, samples: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Sampled fractions of each walk, and which bit of a word's hash is the random bit of each of its steps."""
    rng = np.random.default_rng(seed)
    return np.sort(rng.random((repeats, samples)), axis=1), rng.integers(0, 64, (repeats, 4096)).astype(np.uint64)


def cgk_keys(words: np.ndarray, start: np.ndarray, have: np.ndarray, size: int, repeats: int, samples: int) -> np.ndarray:
    """keys[window, repeat]: a hash of the sampled symbols of each walk over windows of one size.

    A window has the ``have`` words from ``start`` on and counts as ``size`` words; its walk has
    3 * size steps, and past its words it emits a blank.
    """
    at, bit = plan(repeats, samples)
    wanted = (at * (3 * size)).astype(np.int64)  # the sampled steps of each walk, in order
    key = np.repeat((np.arange(repeats, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(size))[:, None], len(start), axis=1)
    padded = np.append(words, np.uint64(0))
    blank = len(words)
    order = np.argsort(-wanted[:, -1], kind="stable")  # walks that end first are dropped from the end
    upto, key, wanted, bit = wanted[order, -1], key[order], wanted[order], bit[order]
    at = np.repeat(start[None].astype(np.int64), repeats, axis=0)
    end = (start + have).astype(np.int64)
    for j in range(int(upto.max(initial=-1)) + 1):
        n = int(np.searchsorted(-upto, -j, side="right"))
        p = at[:n]
        inside = p < end
        symbol = padded[np.where(inside, p, blank)]
        for r in np.flatnonzero((wanted[:n] == j).any(axis=1)):
            for _ in range(int((wanted[r] == j).sum())):
                key[r] = mix(key[r] ^ symbol[r])
        p += ((symbol >> bit[:n, j % 4096, None]) & np.uint64(1)).astype(np.int64) & inside
    out = np.empty_like(key)
    out[order] = key
    return out.T


def missing(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``a`` that ``b`` has nowhere. Each costs an edit, so the distance to any run of ``b`` is no less."""
    there = np.sort(b)
    at = np.minimum(np.searchsorted(there, a), len(there) - 1)
    return int((there[at] != a).sum()) if len(there) else len(a)


def edit_distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Fewest word insertions, deletions and substitutions that turn ``a`` into some run of ``b``; and that run's bounds."""
    n = len(b)
    at = np.arange(n + 1)
    cell = at.astype(np.int64)  # cost << 32 | where the run starts
    for x in a.tolist():
        best = np.empty(n + 1, np.int64)
        best[0] = cell[0] + (1 << 32)
        best[1:] = np.minimum(cell[:-1] + ((b != x).astype(np.int64) << 32), cell[1:] + (1 << 32))
        cell = np.minimum.accumulate(best - (at << 32)) + (at << 32)  # insertions run along the row
    end = int((cell >> 32).argmin())
    return int(cell[end] >> 32), int(cell[end] & 0xFFFFFFFF), end


def items(benchmark: DataFrame, id_col: str, text_col: str, repeats: int, samples: int) -> DataFrame:
    """(item_id, words, size, keys): the CGK keys of each benchmark item of at least one word."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch.column(1)):
                ids = batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist()
                out = [[], [], [], []]
                for i, item in enumerate(ids):
                    w = s.hash[s.row[i] : s.row[i + 1]]
                    if not len(w) or item is None:
                        continue
                    size = int(size_class(len(w)))
                    keys = cgk_keys(w, np.zeros(1, np.int64), np.array([min(size, len(w))]), size, walks(size, repeats), samples)[0]
                    for c, v in zip(out, (item, w.view(np.int64), size, keys.view(np.int64)), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["item_id", "words", "size", "keys"])

    return benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, 
        run, "item_id long, words array<long>, size int, keys array<long>"
    )


def word_pairs(known: DataFrame) -> DataFrame:
    """Hashes of the adjacent word pairs (of one-word items, the word) of all items."""
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(a, b).view(np.int64))], ["pair"])

    return known.select(F.explode(pairs).alias("p")).select("p.a", "p.b").transform(in_arrow, run, "pair long").distinct()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def windows(docs: DataFrame, id_col: str, text_col: str, sizes: list[tuple[int, int, int]], pairs: np.ndarray, keys_of: np.ndarray, repeats: int, samples: int, percent: int) -> DataFrame:
    """(doc_id, start, first, near, keys): windows with enough known word pairs and a key that an item may have.

    sizes: window size, least and greatest item length of each class; pairs and keys_of: filters of fixed size.
    ``near`` has the hashes of the words around the window, from word ``first``, within reach of the
    edits, for the exact check. Of equal windows in one text the first stands for all.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch.column(1)):
                ids = batch.column(0).slice(s.lo, s.hi - s.lo)
                n = len(s.hash)
                if not n:
                    continue
                row = np.repeat(np.arange(s.hi - s.lo), s.counts())
                known = np.zeros(n, np.int64)
                if n > 1:
                    known[:-1] = in_bloom(pairs, pair_hash(s.hash[:-1], s.hash[1:]).view(np.int64)) & (row[1:] == row[:-1])
                total = np.concatenate([[0], np.cumsum(known)])
                end_of = s.row[row + 1]
                where = np.arange(n)
                found = []
                for size, least, most in sizes:
                    need = pairs_needed(size, least, most, percent)
                    stop = np.minimum(where + size, end_of)
                    starts = np.flatnonzero(total[np.maximum(stop - 1, where)] - total[:n] >= need)
                    if not len(starts):
                        continue
                    content = np.zeros(len(starts), np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(size):
                            at = starts + j
                            content = content * np.uint64(0xD6E8FEB86659FD93) + np.where(at < end_of[starts], s.hash[np.minimum(at, n - 1)], np.uint64(0))
                        once = np.unique(mix(content) + mix(row[starts].astype(np.uint64)), return_index=True)[1]
                    many = walks(size, repeats)
                    step = max(1, 96_000 // many)
                    found += [(starts[once[lo : lo + step]], size, many) for lo in range(0, len(once), step)]
                for part, size, many in found:
                    keys = cgk_keys(s.hash, part, np.minimum(size, end_of[part] - part), size, many, samples)
                    hit = in_bloom(keys_of, keys.ravel().view(np.int64)).reshape(keys.shape)
                    keep = np.flatnonzero(hit.any(axis=1))
                    if not len(keep):
                        continue
                    part, keys, hit = part[keep], keys[keep], hit[keep]
                    reach = int(size * SIZES) + 1
                    slack = allowed(reach, percent) + 2 + RUN
                    first = np.maximum(part - slack, s.row[row[part]])
                    last = np.minimum(part + reach + slack, end_of[part])
                    own = s.row[row[part]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(row[part])), pa.array(part - own), pa.array(first - own),
                            pa.array([s.hash[a:b].view(np.int64) for a, b in zip(first, last, strict=True)], pa.list_(pa.int64())),
                            pa.array([k[h].view(np.int64) for k, h in zip(keys, hit, strict=True)], pa.list_(pa.int64())),
                        ],
                        ["doc_id", "start", "first", "near", "keys"],
                    )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, 
        run, "doc_id long, start long, first long, near array<long>, keys array<long>"
    )


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    percent: int = MAX_EDIT_PERCENT, repeats: int = REPEATS, samples: int = SAMPLES, min_item: int = MIN_ITEM,
) -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word: each item within ``percent`` % word edits of a passage of each text.

    Case of A-Z is ignored. Items of fewer than ``min_item`` words are no evidence and are left out, as
    are rows with a null id and texts without words. Repeated rows give one result. Empty tables give none.
    """
    known = written(items(benchmark, item_col, item_text, repeats, samples).where(F.size("words") >= min_item), "items")
    sizes = known.groupBy("size").agg(F.min(F.size("words")).alias("least"), F.max(F.size("words")).alias("most")).orderBy("size").collect()  # one row per class
    if not sizes:
        return known.select(F.lit(0).cast("long").alias("doc_id"), "item_id", F.lit(0).alias("edits"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("end_word")).where("false")
    pairs = bloom(word_pairs(known), "pair")
    keyed = known.select("item_id", F.explode("keys").alias("key"))
    found = windows(docs.where(F.col(id_col).isNotNull()), id_col, text_col, [(r["size"], r["least"], r["most"]) for r in sizes], pairs, bloom(keyed, "key"), repeats, samples, percent)
    few = known.agg(F.sum(F.size("words") + F.size("keys") + 4)).first()[0] <= BROADCAST_HASHES
    hits = found.withColumn("key", F.explode(F.array_distinct("keys"))).join(F.broadcast(keyed) if few else keyed, "key")
    # One window of a run of hits is enough for the check, as it looks beyond the window's ends.
    hits = hits.groupBy("doc_id", "item_id", F.floor(F.col("start") / RUN).alias("run")).agg(F.min(F.struct("start", "first", "near")).alias("w"))

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(5)]
            for doc, item, words, first, near in zip(*(batch.column(i) for i in range(5)), strict=True):
                a, b = (np.array(x.values.to_numpy(zero_copy_only=False)) for x in (words, near))
                if missing(a, b) > allowed(len(a), percent):
                    continue
                d, lo, hi = edit_distance(a, b)
                if d <= allowed(len(a), percent):
                    f = first.as_py()
                    for c, v in zip(out, (doc.as_py(), item.as_py(), d, f + lo, f + hi), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "item_id", "edits", "first_word", "end_word"])

    texts = known.select("item_id", "words")
    verified = hits.join(F.broadcast(texts) if few else texts, "item_id").select("doc_id", "item_id", "words", "w.first", "w.near").transform(in_arrow, 
        check, "doc_id long, item_id long, edits int, first_word long, end_word long"
    )
    return verified.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, item_id, edits, n_places for each item found in each text."""
    spans = contaminated_spans(docs, benchmark, **kw)
    return spans.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.countDistinct("first_word").alias("n_places"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs, unchanged, in whose text no item was found."""
    name = free_name(docs, "_gone")
    gone = leaks(docs, benchmark, id_col=id_col, **kw).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(small(gone), F.col(id_col) == F.col(name), "left_anti")
