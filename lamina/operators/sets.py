"""Counts of what sets have in common, for sets given as rows (key, coordinates)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranges import ranked
from lamina.sources.scratch import saved

BLOCK = 1024  # keys of a block
PAIRED = 64  # keys of a place that are paired as rows, at least
TASK_PLACES = 1 << 16  # places of a task, about
COLUMNS = 2048  # places of one product
DENSE = 4096  # pairs of a place, beyond which a product costs less
FEW = 1 << 19  # keys that may be broadcast
ROWS = 1 << 16  # pairs of a batch


def shared_places(sets: DataFrame, key: str, on: list[str]) -> DataFrame:
    """The rows whose place ``on`` another key has too; repeated rows count once, a null coordinate is no place."""
    rows = sets.select(key, *on).dropna(subset=on).distinct()
    return rows.join(rows.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), on, "left_semi")


def common_counts(sets: DataFrame, key: str, on: list[str], name: str) -> DataFrame:
    """(a, b, name): in how many places ``on`` the keys a < b meet; pairs without any are left out.

    Places that the same keys share are counted first, and one place stands for all of them when keys are paired,
    so a boundary of a million places between two keys costs one pair. Sameness is told by the number of the keys,
    their ends and two exclusive-ors of 64-bit hashes. A place of few keys pairs them as rows; one of many goes as
    lists of keys to the tasks of pairs of key blocks, which count by products of matrices (key by place). Pairs are
    as many as the result asks for.
    """
    rows = saved(sets.select(F.col(key).alias("_k"), *on).dropna().distinct())
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "_k")).alias(f"_h{seed}") for seed in (0, 1)]
    place = rows.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_k").alias("_low"), F.max("_k").alias("_high"), *hashes).where("_n > 1")
    alike = place.groupBy("_n", "_low", "_high", "_h0", "_h1").agg(F.count("*").alias("_places"), F.min(F.struct(*on)).alias("_one"))
    alike = saved(alike.select("_one.*", "_places", "_n"))
    keys = rows.select("_k").distinct()
    few = max(PAIRED, 16 * -(-keys.count() // BLOCK))  # beyond it a product costs less than pairs
    of = rows.join(alike.where(F.col("_n") <= few), on)
    left = of.select(*on, "_places", F.col("_k").alias("a"))
    right = of.select(*on, F.col("_k").alias("b"))
    pairs = left.join(right, on).where("a < b").groupBy("a", "b").agg(F.sum("_places").alias(name))
    crowded = alike.where(F.col("_n") > few)
    places = crowded.count()
    if not places:
        return pairs
    more = _crowded_counts(rows.join(crowded, on), keys, on, -(-places // TASK_PLACES)).withColumnRenamed("_common", name)
    return pairs.unionByName(more).groupBy("a", "b").agg(F.sum(name).alias(name))


def _crowded_counts(of: DataFrame, keys: DataFrame, on: list[str], parts: int) -> DataFrame:
    """(a, b, _common) of rows (key, place, its weight _places), by pairs of key blocks and ``parts`` shares of the places."""
    numbered = saved(ranked(keys, "_k").select("_k", F.expr(f"cast((rank - 1) div {BLOCK} as int)").alias("_b"), F.expr(f"cast((rank - 1) % {BLOCK} as int)").alias("_i")))
    lists = saved(of.join(numbered, "_k").groupBy(*on, "_b").agg(F.first("_places").alias("_places"), F.collect_list("_i").alias("_in")))
    left = lists.select(*on, F.col("_places").alias("places"), F.col("_b").alias("block_a"), F.col("_in").alias("in_a"))
    right = lists.select(*on, F.col("_b").alias("block_b"), F.col("_in").alias("in_b"))
    met = left.join(right, on).where("block_a <= block_b").withColumn("part", F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int"))
    met = met.select("block_a", "block_b", "part", "places", "in_a", "in_b").groupBy("block_a", "block_b", "part")
    counts = met.applyInArrow(_products, "block_a int, i_a int, block_b int, i_b int, _common long")
    side = lambda x: numbered.select(F.col("_k").alias(x), F.col("_b").alias(f"block_{x}"), F.col("_i").alias(f"i_{x}"))
    return counts.join(side("a"), ["block_a", "i_a"]).join(side("b"), ["block_b", "i_b"]).select("a", "b", "_common")


def _indicators(lists) -> np.ndarray:
    """A column for each list, with ones in the rows it names."""
    at = lists.flatten().to_numpy()
    out = np.zeros((int(at.max()) + 1, len(lists)), np.float64)
    out[at, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())] = 1
    return out


def _products(table):
    total = np.zeros((BLOCK, BLOCK), np.int64)
    for lo in range(0, table.num_rows, COLUMNS):
        part = table.slice(lo, COLUMNS).combine_chunks()
        weight = part.column("places").to_numpy()
        # whole numbers, exact in single precision below 2 ** 24
        kind = np.float32 if weight.sum() < 1 << 24 else np.float64
        a, b = (_indicators(part.column(c).combine_chunks()) for c in ("in_a", "in_b"))
        total[: len(a), : len(b)] += ((a * weight).astype(kind) @ b.astype(kind).T).astype(np.int64)
    blocks = [table.column(c)[0].as_py() for c in ("block_a", "block_b")]
    i, j = np.nonzero(np.triu(total, 1) if blocks[0] == blocks[1] else total)
    columns = [np.full(len(i), blocks[0], np.int32), i.astype(np.int32), np.full(len(i), blocks[1], np.int32), j.astype(np.int32), total[i, j]]
    return pa.table([pa.array(c) for c in columns], names=["block_a", "i_a", "block_b", "i_b", "_common"])


# ---- two collections ----------------------------------------------------------------------------


def met_counts(left: DataFrame, right: DataFrame, on: list[str], name: str, grown: Sequence[tuple] = (), keys: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b, name): in how many places ``on`` a key of ``left`` (a, places) meets one of ``right`` (b, places); pairs without any are left out.

    Repeated rows count once, a null coordinate is no place. ``grown`` are offsets to which all places of ``left`` spread first.
    ``keys`` are the tables of a and of b, whose further columns the result has too. Keys are never paired as rows: each place has
    lists of its keys, which go to the tasks of pairs of blocks of keys, where they are counted.
    """
    keys = keys or (left.select("a").distinct(), right.select("b").distinct())
    numbered = [_numbered(k, side) for k, side in zip(keys, "ab", strict=True)]
    lists = [_lists(rows, of, on, side) for rows, of, side in zip((left, right), numbered, "ab", strict=True)]
    if grown:
        o = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(on, step, strict=True))) for step in grown))
        spread = lists[0].withColumn("_o", F.explode(o)).select(*((F.col(c) + F.col(f"_o.{c}")).alias(c) for c in on), "block_a", "in_a")
        lists[0] = spread.groupBy(*on, "block_a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("in_a")))).alias("in_a"))
    lists[0] = saved(lists[0])
    parts = max(1, lists[0].count() // (TASK_PLACES * max(1, lists[0].select("block_a").distinct().count())))
    met = lists[0].join(lists[1], on).withColumn("part", F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int"))
    counts = met.select("block_a", "block_b", "part", "in_a", "in_b").groupBy("block_a", "block_b", "part").applyInArrow(_met, "block_a int, i_a short, block_b int, i_b short, _n long")
    if parts > 1:
        counts = counts.groupBy("block_a", "i_a", "block_b", "i_b").agg(F.sum("_n").alias("_n"))
    for of, side in zip(numbered, "ab", strict=True):
        counts = counts.join(F.broadcast(of) if of.count() <= FEW else of, [f"block_{side}", f"i_{side}"])
    return counts.select(*keys[0].columns, *keys[1].columns, F.col("_n").alias(name))


def _numbered(keys: DataFrame, side: str) -> DataFrame:
    """The keys with their block and number in it."""
    rank = ranked(keys.dropna(subset=[side]), side)
    return saved(rank.select(*keys.columns, F.expr(f"cast((rank - 1) div {BLOCK} as int)").alias(f"block_{side}"), F.expr(f"cast((rank - 1) % {BLOCK} as short)").alias(f"i_{side}")))


def _lists(rows: DataFrame, numbered: DataFrame, on: list[str], side: str) -> DataFrame:
    """For each place and block of keys, those that stand there."""
    of = numbered.select(side, f"block_{side}", f"i_{side}")
    of = F.broadcast(of) if of.count() <= FEW else of
    rows = rows.select(side, *on).dropna().join(of, side)
    return rows.groupBy(*on, f"block_{side}").agg(F.array_sort(F.collect_set(f"i_{side}")).alias(f"in_{side}"))


def _met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a pair of blocks: by products of matrices (key by place) where lists are long, pair by pair where they are short."""
    total = np.zeros((BLOCK, BLOCK), np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, COLUMNS):
            a, b = (batch.slice(lo, COLUMNS).column(c) for c in ("in_a", "in_b"))
            m, n = (x.value_lengths().to_numpy().astype(np.int64) for x in (a, b))
            if (m * n).sum() > DENSE * len(m):
                p, q = (_indicators(x).astype(np.float32) for x in (a, b))  # whole numbers up to COLUMNS, exact
                total[: len(p), : len(q)] += (p @ q.T).astype(np.int64)
                continue
            left, right = (x.flatten().to_numpy().astype(np.int64) for x in (a, b))
            width = np.repeat(n, m)
            at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(np.repeat(np.cumsum(n) - n, m), width)
            total += np.bincount(np.repeat(left, width) * BLOCK + right[at], minlength=BLOCK * BLOCK).reshape(BLOCK, BLOCK)
    i, j = np.nonzero(total)
    for lo in range(0, len(i), ROWS):
        p, q = i[lo : lo + ROWS], j[lo : lo + ROWS]
        blocks = [pa.array(np.full(len(p), k.as_py(), np.int32)) for k in key[:2]]
        yield pa.RecordBatch.from_arrays([blocks[0], pa.array(p.astype(np.int16)), blocks[1], pa.array(q.astype(np.int16)), pa.array(total[p, q])], names=["block_a", "i_a", "block_b", "i_b", "_n"])
