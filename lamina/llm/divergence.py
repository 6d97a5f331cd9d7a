"""Audit of how far the sources of a language diverge in their use of terms.

The counts of a language form a matrix of sources by terms. Its columns are dealt by hash to blocks of bounded
size, and each block is held as a forest of K²-trees (k = 2): quadrants without a count are not stored. All pairs
of sources are compared by one joint walk down the tree: two quadrants that are both empty stand for so many
terms whose shares are those of a count of zero, and are priced by a product; only where one of the two holds a
count does the walk go on, down to single cells. The blocks' sums are added up by Spark.

Terms are runs of characters other than ASCII non-letters, A-Z lower-cased; null text, lang and source count as
''. A language keeps the terms in at least ``MIN_DOCS`` of its documents (rows). All arithmetic is in integers.
A language without kept terms has pairs of value 0; an empty table gives no rows; repeated rows count each time;
other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_text, in_arrow, small, written
from .words import text_buffer

MIN_DOCS = 3
TOP_TERMS = 200
SCALE_STEPS, STEP = 3, 1000  # shares are in billionths: three digits to the base 1000
BLOCK_CELLS = 1 << 18  # counts of a block, about
FRONTIER = 1 << 19  # pairs of nodes that are expanded together
PIECE_BYTES = 1 << 20
FLUSH_TERMS = 1 << 18
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_ONES = np.array([bin(m).count("1") for m in range(16)])


# ---- counts -------------------------------------------------------------------------------------


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of about a megabyte that end at a separator."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        cut = raw.find(b" ", at + PIECE_BYTES)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _count_task(batches):
    """Per task, (lang, source, term, n, docs) sums of bounded size; a row with the term '' marks each group."""
    groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0

    def flush():
        for (lang, source), terms in groups.items():
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n), pa.array([source] * n), pa.array(list(terms), pa.binary()).cast(pa.string()),
                    pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        buf, at = text_buffer(batch.column(2))
        folded = buf.tobytes().translate(_FOLD)
        for i, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            seen: Counter[bytes] = Counter()
            for piece in _pieces(folded[at[i] : at[i + 1]]):
                seen.update(piece.split())
            terms = groups.setdefault((lang, source), {b"": [0, 0]})
            before = len(terms)
            for term, n in seen.items():
                cell = terms.get(term)
                if cell is None:
                    terms[term] = [n, 1]
                else:
                    cell[0] += n
                    cell[1] += 1
            held += len(terms) - before
            if held > FLUSH_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and documents of the group that have it.

    Every group also has a row with the term ''.
    """
    rows = docs.select(*(empty_text(F.col(c)).alias(c) for c in ("lang", "source", "text")))
    part = in_arrow(rows, _count_task, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- K²-trees -----------------------------------------------------------------------------------


class Forest:
    """K²-trees over squares of columns, each 2^h columns wide for 2^h >= rows.

    A node's four children (two row halves by two column halves) are a mask of bits; a child's place in the next
    level is the place of the node's first child plus the number of set bits before its own.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int):
        self.rows, self.cols = rows, cols
        self.height = max(0, (rows - 1).bit_length())
        code = col >> self.height
        for b in reversed(range(self.height)):
            code = code * 4 + (row >> b & 1) * 2 + (col >> b & 1)
        self.order = np.argsort(code)  # of the cells: leaf i is cell order[i]
        nodes = code[self.order]
        self.levels = []
        for _ in range(self.height):
            parent, first = np.unique(nodes >> 2, return_index=True)
            self.levels.insert(0, (np.bitwise_or.reduceat(1 << (nodes & 3), first), first))
            nodes = parent
        self.squares = nodes

    def child(self, level: int, node: np.ndarray, digit: int) -> np.ndarray:
        """Places in the next level, -1 where that quadrant is empty."""
        if not len(self.levels[level][0]):
            return np.full(len(node), -1)
        mask, first = (x[np.maximum(node, 0)] for x in self.levels[level])
        there = (node >= 0) & (mask >> digit & 1 == 1)
        return np.where(there, first + _ONES[mask & ((1 << digit) - 1)], -1)

    def pairs(self, leaf, limit: int = FRONTIER) -> np.ndarray:
        """Walks all pairs of rows a < b at once. ``leaf(a, b, ia, ib)`` gets pairs of cells of one column, -1 for an
        empty one, never two. Returns how many columns of each pair are empty in both rows."""
        empty = [np.zeros((1 << k, 1 << k), dtype=np.int64) for k in range(self.height + 1)]
        every = np.arange(-(-self.cols >> self.height) if self.cols else 0)
        at = np.searchsorted(self.squares, every)
        root = np.where(np.append(self.squares, -1)[at] == every, at, -1)
        none = root < 0
        empty[0][0, 0] = np.sum(np.minimum(self.cols, (every[none] + 1) << self.height) - (every[none] << self.height))
        root, every = root[~none], every[~none]
        stack = [(0, root, root, np.zeros_like(every), np.zeros_like(every), every)]
        while stack:
            level, ia, ib, a, b, col = stack.pop()
            if len(col) > limit:
                half = len(col) // 2
                stack += [(level, *(x[s] for x in (ia, ib, a, b, col))) for s in (slice(half), slice(half, None))]
                continue
            if level == self.height:
                other = a < b
                leaf(a[other], b[other], ia[other], ib[other])
                continue
            shift, found = self.height - level - 1, []
            for q in range(8):
                qa, qb, qc = q >> 2, q >> 1 & 1, q & 1
                na, nb, nc = 2 * a + qa, 2 * b + qb, 2 * col + qc
                use = (na <= nb) & (nb << shift < self.rows) & (nc << shift < self.cols)
                na, nb, nc = na[use], nb[use], nc[use]
                ja, jb = self.child(level, ia[use], 2 * qa + qc), self.child(level, ib[use], 2 * qb + qc)
                both = (ja < 0) & (jb < 0)
                width = np.minimum(self.cols, (nc[both] + 1) << shift) - (nc[both] << shift)
                np.add.at(empty[level + 1], (na[both], nb[both]), width)
                found.append([x[~both] for x in (ja, jb, na, nb, nc)])
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))
        total = empty[0]
        for k in range(1, self.height + 1):
            total = total.repeat(2, 0).repeat(2, 1) + empty[k]
        return total[: self.rows, : self.rows]


def share(count: np.ndarray, total, vocabulary: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + vocabulary)), by long division, so that nothing overflows."""
    of = np.asarray(total, dtype=np.int64) + vocabulary
    rest, out = np.asarray(count, dtype=np.int64) + 1, 0
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * STEP, of)
        out = out * STEP + digit
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compare_block(row, col, count, totals: np.ndarray, cols: int, vocabulary: int):
    """(pair values, per cell gap to the language or -1): of one block of columns, every row with its total."""
    rows = len(totals)
    values = np.zeros((rows, rows), dtype=np.int64)
    if not cols:
        return values, np.zeros(0, dtype=np.int64)
    forest = Forest(row, col, rows, cols)
    p = share(count, totals[row], vocabulary)
    held, zero = p[forest.order], share(np.zeros(rows, dtype=np.int64), totals, vocabulary)

    def leaf(a, b, ia, ib):
        pa_, pb = np.where(ia >= 0, held[ia], zero[a]), np.where(ib >= 0, held[ib], zero[b])
        np.add.at(values, (a, b), gap(pa_, pb))
        np.add.at(values, (b, a), gap(pb, pa_))

    empty = np.triu(forest.pairs(leaf), 1)
    values += (empty + empty.T) * gap(zero[:, None], zero[None, :])
    whole = np.zeros(cols, dtype=np.int64)
    np.add.at(whole, col, count)
    q = share(whole, int(totals.sum()), vocabulary)[col]
    return values, np.where(p > q, gap(p, q), -1)


def _block_task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    is_group = pc.equal(table.column("term"), "")
    groups, cells = table.filter(is_group), table.filter(pc.invert(is_group))
    sources = pc.take(groups.column("source"), pc.sort_indices(groups.column("source"))).combine_chunks()
    totals = np.zeros(len(sources), dtype=np.int64)
    totals[pc.index_in(groups.column("source"), sources).to_numpy()] = groups.column("n").to_numpy()
    terms = pc.unique(cells.column("term"))
    terms = pc.take(terms, pc.sort_indices(terms))
    row = pc.index_in(cells.column("source"), sources).to_numpy().astype(np.int64)
    col = pc.index_in(cells.column("term"), terms).to_numpy().astype(np.int64)
    count = cells.column("n").to_numpy()
    values, ahead = compare_block(row, col, count, totals, len(terms), int(groups.column("vocabulary")[0].as_py()))
    lang = key[0].as_py()

    def rows(part, source, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value)], ["lang", "source", "part", "item", "value"])

    n, every = len(sources), np.arange(len(sources))
    step = max(1, FRONTIER // max(1, n))
    for lo in range(0, n, step):
        a, b = np.repeat(every[lo : lo + step], n), np.tile(every, len(every[lo : lo + step]))
        a, b = a[a != b], b[a != b]
        yield rows("pair", sources.take(pa.array(a)), sources.take(pa.array(b)), values[a, b])
    # of one source the block's first TOP_TERMS hold whatever the block gives to the first TOP_TERMS of all
    order = np.lexsort((col, -ahead, row))
    order = order[ahead[order] >= 0]
    of = row[order]
    order = order[np.arange(len(of)) - np.searchsorted(of, of) < TOP_TERMS]
    yield rows("term", sources.take(pa.array(row[order])), terms.take(pa.array(col[order])), ahead[order])


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source, the other sources of its language and its foremost terms.

    ``pair`` ranks all other sources by the divergence summed over all kept terms; ``term`` ranks the TOP_TERMS
    terms that the source uses more than its language does.
    """
    same = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"_docs": F.sum("docs").over(same), "_one": F.row_number().over(same.orderBy("source"))})
    kept = written(kept.where((F.col("term") == "") | (F.col("_docs") >= MIN_DOCS)).select("lang", "source", "term", "n", "_one"), "divergence-counts")
    is_term = F.col("term") != ""
    groups = written(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.when(is_term & (F.col("_one") == 1), 1).otherwise(0)).alias("v"), F.sum(is_term.cast("long")).alias("cells")),
        "divergence-groups",
    )
    langs = groups.groupBy("lang").agg(F.sum("v").alias("vocabulary"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / BLOCK_CELLS)).cast("long").alias("blocks"))
    langs = written(langs, "divergence-langs")
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    cells = kept.where(is_term).join(small(langs), "lang").select("lang", block.alias("block"), "source", "term", "n", "vocabulary")
    heads = groups.join(small(langs), "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit("").alias("term"), "n", "vocabulary")
    out = written(
        cells.unionByName(heads).groupBy("lang", "block").applyInArrow(_block_task, "lang string, source string, part string, item string, value long"),
        "divergence-blocks",
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = out.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = out.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)
