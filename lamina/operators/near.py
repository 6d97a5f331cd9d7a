"""Near points by tiles with a margin, for jobs whose pairs are many more than their points.

Space is cut into tiles many radii wide; a point goes to its own tile and, as a partner, to those within the radius, so
that little more than the points is shuffled, and pairs never are. A task holds a tile and its margin as arrays, finds the pairs
through cells and goes over them in pieces. A crowded tile is cut into cells of one radius, each a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.geometry import cell
from lamina.sources.scratch import saved

WIDE = 16  # radii to the side of a tile
CROWDED = 1 << 18  # points of a tile, beyond which it is cut
PIECE = 1 << 20  # pairs that are looked at in one go


def tiled(points: DataFrame, others: DataFrame | None, coords: str, radius: float, wide: int = WIDE, crowded: int = CROWDED):
    """The rows of both tables grouped by tile; ``_left`` marks points at home in the tile, ``_right`` possible partners.

    Without ``others`` the points are partners of one another. Rows with a null are left out.
    """
    names, size = coords.split(), max(1, math.ceil(radius))
    side = wide * size
    rows = points.dropna().withColumns({"_left": F.lit(True), "_right": F.lit(others is None)})
    if others is not None:
        rows = rows.unionByName(others.select(points.columns).dropna().withColumns({"_left": F.lit(False), "_right": F.lit(True)}))
    rows = saved(rows)
    keys = [f"b{i}" for i in range(len(names))]
    full = rows.groupBy(*(cell(F.col(c), side).alias(k) for k, c in zip(keys, names, strict=True))).agg(F.count("*").alias("_n"))
    full = saved(full.where(F.col("_n") > crowded).select(*keys, F.lit(True).alias("_full")))
    own = F.lit(True)
    for k, c in zip(keys, names, strict=True):
        rows = rows.withColumn(k, F.explode(F.sequence(cell(F.col(c) - size, side), cell(F.col(c) + size, side))))
        own = own & (F.col(k) == cell(F.col(c), side))
    rows = rows.withColumn("_left", F.col("_left") & own).where("_left or _right")
    if full.limit(1).count():
        rows, own = rows.join(F.broadcast(full), keys, "left"), F.lit(True)
        for i, c in enumerate(names):
            lo, hi = F.greatest(cell(F.col(c) - size, size), F.col(f"b{i}") * wide), F.least(cell(F.col(c) + size, size), F.col(f"b{i}") * wide + (wide - 1))
            rows = rows.withColumn(f"s{i}", F.explode(F.when(F.col("_full"), F.sequence(lo, hi)).otherwise(F.array(F.lit(0).cast("long")))))
            own = own & (F.col(f"s{i}") == cell(F.col(c), size))
            keys.append(f"s{i}")
        rows = rows.withColumn("_left", F.col("_left") & (F.col("_full").isNull() | own)).where("_left or _right").drop("_full")
    return rows.groupBy(*keys)


def close(at: list[np.ndarray], left: np.ndarray, right: np.ndarray, radius: float, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs nearer than ``radius``, in pieces; all pairs of a row of ``left`` are in one piece, one after the other."""
    if not len(left) or not len(right):
        return
    size = max(1, math.ceil(radius))
    cells = [np.floor(a / size).astype(np.int64) for a in at]
    cells = [c - c.min() + 1 for c in cells]
    width = [int(c.max()) + 2 for c in cells]
    steps = [math.prod(width[i + 1 :]) for i in range(len(at))]
    key = sum(c * s for c, s in zip(cells, steps, strict=True))
    left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
    here, there = [a[left] for a in at], [a[right] for a in at]
    # cells that follow one another along the last axis are one run of the partners
    different, which = np.unique(key[left], return_inverse=True)
    ring = np.array([sum(o * s for o, s in zip(os, steps, strict=False)) for os in product((-1, 0, 1), repeat=len(at) - 1)], dtype=np.int64)
    around, ordered = different[:, None] + ring, key[right]
    lo, hi = np.searchsorted(ordered, around - 1, "left"), np.searchsorted(ordered, around + 1, "right")
    total = np.cumsum((hi - lo).sum(1)[which])
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + piece, "right")))
        runs, n = lo[which[a:b]].ravel(), (hi - lo)[which[a:b]]
        j = np.arange(n.sum()) + np.repeat(runs - (np.cumsum(n.ravel()) - n.ravel()), n.ravel())
        n = n.sum(1)
        d = sum((np.repeat(h[a:b], n) - t[j]) ** 2 for h, t in zip(here, there, strict=True))
        d = np.sqrt(d.astype(np.float64))
        near = np.nonzero(d < radius)[0]
        yield np.repeat(left[a:b], n)[near], right[j[near]], d[near]
        a = b


def least(start: np.ndarray, dist: np.ndarray, tie: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1, 2, ... the place of the k-th least of each group, which begin at ``start``; and how many each group has. Ties differ within a group."""
    n = np.diff(np.append(start, len(dist)))
    dist, out = dist.copy(), []
    for _ in range(k):
        first = dist == np.repeat(np.minimum.reduceat(dist, start), n)
        by = np.where(first, tie, np.iinfo(tie.dtype).max)
        out.append(np.nonzero(first & (by == np.repeat(np.minimum.reduceat(by, start), n)))[0])
        dist[out[-1]] = np.inf
    return out, n


def starts(group: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]


def ranks(keys: list[np.ndarray]) -> np.ndarray:
    """The place of each row in the order of ``keys``."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def arrays(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {n: table.column(n).to_numpy() for n in table.column_names}


def nearest_of_others(points: DataFrame, key: str, place: list[str], coords: str, radius: float, k: int, wide: int = WIDE, crowded: int = CROWDED) -> DataFrame:
    """(l_<key>, l_<place>, r_<key>, r_<place>, rank, dist): the k nearest points within ``radius`` (strictly) of other keys; ties by key and place."""
    names, axes = [key, *place], coords.split()
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"{s}_{n} {types[n]}" for s in "lr" for n in names) + ", rank int, dist double"

    def task(tile: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = arrays(batches)
        tie = ranks([t[n] for n in names])
        for i, j, d in close([t[a] for a in axes], np.nonzero(t["_left"])[0], np.nonzero(t["_right"])[0], radius):
            other = t[key][i] != t[key][j]
            i, j, d = i[other], j[other], d[other]
            if not len(i):
                continue
            start = starts(i)
            best, n = least(start, d, tie[j], k)
            for rank, at in enumerate(best, 1):
                at = at[n >= rank]
                columns = [pa.array(t[c][s[at]]) for s in (i, j) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), rank, np.int32)), pa.array(d[at])], [*(f"{s}_{c}" for s in "lr" for c in names), "rank", "dist"])

    rows = points.select(*names, *(a for a in axes if a not in names))
    return tiled(rows, None, coords, radius, wide, crowded).applyInArrow(task, schema)
