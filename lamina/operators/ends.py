"""First and last patches of walks laid on one another, where walks are many more than patches.

Patches are cut into blocks of about as many points, along their ids; walks go to the pair of blocks of their ends, and a patch to the pairs
that it is needed in, once each, however many walks begin or end there. A task holds the meshes of two blocks; what it compares stays inside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranges import running_sum
from lamina.sources.scratch import saved

TX = "a b c d e f"
POINTS = 1 << 15  # points of a block, about; a patch is never cut
PIECE = 1 << 18  # points that are laid on others in one go
FEW = 1 << 19  # rows of a table that may be broadcast


class Places:
    """Rows of meshes by patch and place; rows are sorted by patch, of which there are ``n``."""

    def __init__(self, patch: np.ndarray, x: np.ndarray, y: np.ndarray, n: int):
        self.count = np.bincount(patch, minlength=n)
        self.start = np.cumsum(self.count) - self.count
        ends = [(np.minimum.reduceat(v, self.start), np.maximum.reduceat(v, self.start)) for v in (x, y)]
        self.low, self.high = [e[0] for e in ends], [e[1] for e in ends]
        self.width = self.high[1] - self.low[1] + 1
        area = (self.high[0] - self.low[0] + 1) * self.width
        self.base = np.cumsum(area) - area
        code = self.base[patch] + (x - self.low[0][patch]) * self.width[patch] + y - self.low[1][patch]
        self.table = None
        if area.sum() <= 64 * len(x) + (1 << 20):
            self.table = np.full(int(area.sum()), -1, np.int64)
            self.table[code] = np.arange(len(x))
        else:
            self.order = np.argsort(code)
            self.code = code[self.order]

    def find(self, patch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The row at a place of a patch, or -1."""
        inside = (x >= self.low[0][patch]) & (x <= self.high[0][patch]) & (y >= self.low[1][patch]) & (y <= self.high[1][patch])
        code = np.where(inside, self.base[patch] + (x - self.low[0][patch]) * self.width[patch] + y - self.low[1][patch], 0)
        if self.table is not None:
            return np.where(inside, self.table[code], -1)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(inside & (self.code[at] == code), self.order[at], -1)


def dot(p, q):
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def mesh_normals(places: Places, patch: np.ndarray, x: np.ndarray, y: np.ndarray, v: list[np.ndarray]) -> list[np.ndarray]:
    """As :func:`mesh.normals`; a missing one is zero, so that it says nothing of a distance."""
    here = np.arange(len(x))
    near = [places.find(patch, x + i, y + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    there = ((near[0] >= 0) | (near[1] >= 0)) & ((near[2] >= 0) | (near[3] >= 0))
    side = [[c[np.where(k >= 0, k, here)] for c in v] for k in near]
    (a, b, c), (p, q, r) = ([m - n for m, n in zip(side[k], side[k + 1], strict=True)] for k in (0, 2))
    n = [b * r - c * q, c * p - a * r, a * q - b * p]
    size = np.sqrt(dot(n, n).astype(np.float64))
    some = there & (size > 0)
    size = np.where(some, size, 1.0)
    return [np.where(some, k / size, 0.0) for k in n]


def _half_up(x: np.ndarray) -> np.ndarray:
    whole = np.trunc(x)
    return np.where(x - whole < 0.5, whole, whole + 1).astype(np.int64)


def compared_ends(walks: DataFrame, points: DataFrame, names: list[str], normal: bool, block: int = POINTS, piece: int = PIECE) -> DataFrame:
    """``names``, cells, worst of each walk (``names``, first, last, a ... f) whose ends share a place.

    The last patch's points are brought into the first one's frame and rounded to its mesh; ``worst`` is the greatest distance of points
    that share a place, along either one's normal or (not ``normal``) in space. ``points`` has pid, qx, qy, vx, vy, vz.
    """
    points = saved(points.select("pid", "qx", "qy", "vx", "vy", "vz").dropna())
    sizes = points.groupBy("pid").agg(F.count("*").alias("n"))
    blocks = saved(running_sum(sizes, "pid", F.col("n"), "upto").select("pid", F.expr(f"(upto - 1) div {block}").alias("_b")))
    small = lambda df: F.broadcast(df) if df.count() <= FEW else df
    of = small(blocks)
    rows = walks
    for end in ("first", "last"):
        rows = rows.join(of.select(F.col("pid").alias(end), F.col("_b").alias(f"_{end}")), end)
    pair = [F.least("_first", "_last").alias("_lo"), F.greatest("_first", "_last").alias("_hi")]
    rows = saved(rows.select(*pair, "first", "last", *dict.fromkeys([*names, *TX.split()])))
    ends = [rows.select("_lo", "_hi", F.col(end).alias("pid")) for end in ("first", "last")]
    needed = saved(ends[0].union(ends[1]).distinct())
    sent = points.join(small(needed), "pid")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def task(w: pa.Table, p: pa.Table) -> pa.Table:
        p = p.sort_by("pid")
        ids, patch = np.unique(p.column("pid").to_numpy(), return_inverse=True)
        x, y = (p.column(f"q{a}").to_numpy() for a in "xy")
        v = [p.column(f"v{a}").to_numpy() for a in "xyz"]
        places = Places(patch, x, y, len(ids))
        n = mesh_normals(places, patch, x, y, v) if normal else None
        first, last = (np.searchsorted(ids, w.column(c).to_numpy()) for c in ("first", "last"))
        a, b, c, d, e, f = (w.column(k).to_numpy() for k in TX.split())
        total = np.cumsum(places.count[last])
        cells, worst = np.zeros(len(last), np.int64), np.zeros(len(last))
        lo = 0
        while lo < len(last):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + piece, "right")))
            many = places.count[last[lo:hi]]
            walk = np.repeat(np.arange(lo, hi), many)
            there = np.arange(many.sum()) + np.repeat(places.start[last[lo:hi]] - (np.cumsum(many) - many), many)
            ux, uy = x[there], y[there]
            qx, qy = _half_up(a[walk] * ux + b[walk] * uy + c[walk]), _half_up(d[walk] * ux + e[walk] * uy + f[walk])
            here = places.find(first[walk], qx, qy)
            met = here >= 0
            walk, there, here = walk[met], there[met], here[met]
            lo = hi
            if not len(walk):
                continue
            gap = [k[here] - k[there] for k in v]
            if normal:
                far = np.maximum(*(np.abs(dot(gap, [k[s] for k in n])) for s in (here, there)))
            else:
                far = np.sqrt(dot(gap, gap).astype(np.float64))
            start = np.nonzero(np.concatenate([[True], walk[1:] != walk[:-1]]))[0]
            worst[walk[start]] = np.maximum.reduceat(far, start)
            cells[walk[start]] = np.diff(np.append(start, len(walk)))
        out = w.select(names).append_column("cells", pa.array(cells)).append_column("worst", pa.array(worst))
        return out.filter(pa.array(cells > 0))

    schema = ", ".join(f"{k} {types[k]}" for k in names) + ", cells long, worst double"
    return rows.groupBy("_lo", "_hi").cogroup(sent.groupBy("_lo", "_hi")).applyInArrow(task, schema)
