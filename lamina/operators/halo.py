"""Stencils of any width over voxel tables, by blocks with a margin.

The volume is cut into cubes; a voxel goes to the cube that it lies in and to those whose stencils reach it, so the rows
that are shuffled do not grow with the cube of a stencil's width, and tasks grow with the volume in every direction. A task
holds one cube and its margin as an array. Neither a line nor a slice of the volume is ever one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
SIDE = 32


class Block:
    """A cube of the volume: dense values (absent ones 0) over what its stencils reach, with places relative to the volume."""

    def __init__(self, low: tuple, size: tuple, home: list[tuple[int, int]], reach: list[tuple[int, int]], places: list[np.ndarray], value: np.ndarray):
        self.low, self.size, self.home, self.reach = low, size, home, reach
        shape = tuple(hi - lo for lo, hi in reach)
        at = tuple(p - lo for p, (lo, _) in zip(places, reach, strict=True))
        self.value, self.there = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
        self.value[at], self.there[at] = value, True

    def places(self, axis: int) -> np.ndarray:
        """The places of the cube itself along an axis."""
        return np.arange(*self.home[axis])

    def take(self, values: np.ndarray, axis: int, places: np.ndarray) -> np.ndarray:
        return np.take(values, places - self.reach[axis][0], axis=axis)

    def here(self, values: np.ndarray) -> np.ndarray:
        for axis in range(3):
            values = self.take(values, axis, self.places(axis))
        return values


def mirrored(place: np.ndarray, size: int, again: bool) -> np.ndarray:
    """Places beyond the ends turned back inside; beyond the upper end the last place comes ``again`` or not. Clipped where an axis is short."""
    place = np.where(place < 0, -place, place)
    place = np.where(place >= size, 2 * size - place - (1 if again else 2), place)
    return np.clip(place, 0, size - 1)


def window(place: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the window around each place, moved inside at the ends so that it stays whole; all of a shorter axis."""
    lo = np.clip(place - radius, 0, max(0, size - 2 * radius - 1))
    return lo, np.minimum(size, lo + 2 * radius + 1)


def reach_of(home: tuple[int, int], size: int, radius: int) -> tuple[int, int]:
    """What a cube's stencils touch: the margin, or the whole window at an end."""
    lo, hi = window(np.array([home[0], home[1] - 1]), size, radius)
    return min(int(lo[0]), max(0, home[0] - radius)), max(int(hi[1]), min(size, home[1] + radius))


def stencil(vox: DataFrame, value: str, out: str, radius: int, run: Callable[[Block], dict[str, np.ndarray]], types: dict[str, str] | None = None, side: int = SIDE) -> DataFrame:
    """(z, y, x, out...) for each voxel of ``vox``: ``run`` gives arrays over the cube of a block, by column name.

    An empty table gives no rows; a voxel that comes twice counts once, with its greatest value; null values are absent.
    """
    types = types or {out: "long"}
    vox = vox.where(F.col(value).isNotNull())
    ends = vox.agg(*(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("l", F.min), ("h", F.max)))).first()
    schema = "z long, y long, x long, " + ", ".join(f"{k} {t}" for k, t in types.items())
    if ends["lz"] is None:
        return vox.sparkSession.createDataFrame([], schema)
    low = tuple(ends[f"l{a}"] for a in AXES)
    size = tuple(ends[f"h{a}"] - ends[f"l{a}"] + 1 for a in AXES)
    rows = vox.select(*((F.col(a) - l).alias(a) for a, l in zip(AXES, low, strict=True)), F.col(value).cast("long").alias("value"))
    for a, n in zip(AXES, size, strict=True):
        last = (n - 1) // side
        near = F.sequence(F.greatest(F.lit(0), F.floor((F.col(a) - 2 * radius) / side)), F.least(F.lit(last), F.floor((F.col(a) + 2 * radius) / side)))
        rows = rows.withColumn(f"b{a}", F.explode(near))
        # of the cubes near by, those that reach here: margins, and at either end of the axis the whole of the first or last window
        lo, hi = F.col(f"b{a}") * side, F.least(F.lit(n), (F.col(f"b{a}") + 1) * side)
        width = min(n, 2 * radius + 1)
        first = F.greatest(F.lit(0), F.least(lo - radius, F.lit(n - width)))
        end = F.greatest(F.least(F.lit(n), hi + radius), F.lit(width))
        rows = rows.where((F.col(a) >= first) & (F.col(a) < end))

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        home = [(int(k.as_py()) * side, min(n, (int(k.as_py()) + 1) * side)) for k, n in zip(key, size, strict=True)]
        reach = [reach_of(h, n, radius) for h, n in zip(home, size, strict=True)]
        # the greatest value of a place is written last
        v = t.column("value").to_numpy()
        order = np.argsort(v, kind="stable")
        block = Block(low, size, home, reach, [t.column(a).to_numpy()[order] for a in AXES], v[order])
        at = np.nonzero(block.here(block.there))
        found = run(block)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(p + h[0] + l, pa.int64()) for p, h, l in zip(at, home, low, strict=True)), *(pa.array(found[k][at]) for k in types)], [*AXES, *types]
        )

    return rows.groupBy("bz", "by", "bx").applyInArrow(task, schema)


# ---- filters ------------------------------------------------------------------------------------


def pascal(width: int) -> list[int]:
    row = [1]
    for _ in range(width - 1):
        row = [a + b for a, b in zip([0, *row], [*row, 0], strict=True)]
    return row


def gaussian_axes(width: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """A row of Pascal's triangle along x, then y, then z, each divided as a whole; mirrored at the ends."""
    row = pascal(width)

    def run(b: Block) -> dict[str, np.ndarray]:
        v = b.value
        for axis in (2, 1, 0):
            here = b.places(axis)
            v = sum(k * b.take(v, axis, mirrored(here + o - width // 2, b.size[axis], True)) for o, k in enumerate(row)) // (1 << (width - 1))
        return {"s": v}

    return run


def _boxes(there: np.ndarray, b: Block, radius: int) -> np.ndarray:
    """How many of ``there`` are in the window of each place of the cube, from running sums along each axis."""
    count = there.astype(np.int64)
    for axis in range(3):
        running = np.cumsum(np.concatenate([np.zeros_like(np.take(count, [0], axis=axis)), count], axis=axis), axis=axis)
        lo, hi = window(b.places(axis), b.size[axis], radius)
        count = np.take(running, hi - b.reach[axis][0], axis=axis) - np.take(running, lo - b.reach[axis][0], axis=axis)
    return count


def equalised(radius: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """Share of the window's voxels that are at most as bright, of 256; all of them give 255."""

    def run(b: Block) -> dict[str, np.ndarray]:
        here, total = b.here(b.value), _boxes(b.there, b, radius)
        rank = np.zeros_like(here)
        for grey in np.unique(here[b.here(b.there)]):
            at = here == grey
            rank[at] = _boxes(b.there & (b.value <= grey), b, radius)[at]
        return {"e": np.minimum(255, 256 * rank // np.maximum(total, 1))}

    return run


def weighted_cube(weights: list[tuple[int, int, int, int]], divisor: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """Sum of the neighbours by whole weights, mirrored at the ends, divided as a whole."""

    def run(b: Block) -> dict[str, np.ndarray]:
        total: np.ndarray | int = 0
        for *o, w in weights:
            v = b.value
            for axis in range(3):
                v = b.take(v, axis, mirrored(b.places(axis) + o[axis], b.size[axis], True))
            total = total + w * v
        return {"s": total // divisor}

    return run


def flatness(radius: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """n, d2: set voxels around each place (mirrored at the ends, the last not again) and the square of their mean offset, in tenths."""

    def run(b: Block) -> dict[str, np.ndarray]:
        span = range(-radius, radius + 1)
        on = (b.value > 0).astype(np.int64)
        # along one axis after the other, counts and sums of offsets
        parts = {"n": on}
        for axis, name in enumerate(AXES):
            new: dict[str, np.ndarray] = {}
            for o in span:
                places = mirrored(b.places(axis) + o, b.size[axis], False)
                for k, v in parts.items():
                    v = b.take(v, axis, places)
                    new[k] = new.get(k, 0) + v
                    if k == "n":
                        new[name] = new.get(name, 0) + o * v
            parts = new
        n = np.maximum(parts["n"], 1)
        return {"n": parts["n"], "d2": sum((10 * parts[a] // n) ** 2 for a in AXES)}

    return run


def sobel(b: Block) -> dict[str, np.ndarray]:
    """dz, dy, dx: [1 2 1] across two axes and the difference before minus after along the third; mirrored at the ends, the last not again."""
    out = {}
    for along, name in enumerate(AXES):
        v = b.value
        for axis in range(3):
            here = b.places(axis)
            before, after = (b.take(v, axis, mirrored(here + o, b.size[axis], False)) for o in (-1, 1))
            v = before - after if axis == along else before + 2 * b.take(v, axis, here) + after
        out[f"d{name}"] = v
    return out


def _shifted(b: Block, values: np.ndarray, radius: int) -> Callable[[tuple[int, int, int]], np.ndarray]:
    """For an offset of up to ``radius``, the values there of each place of the cube; none beyond the volume's ends, where nothing is mirrored."""
    out = np.zeros([hi - lo + 2 * radius for lo, hi in b.home], values.dtype)
    span = [(max(lo - radius, low), min(hi + radius, high)) for (lo, hi), (low, high) in zip(b.home, b.reach, strict=True)]
    to = tuple(slice(s - lo + radius, e - lo + radius) for (s, e), (lo, _) in zip(span, b.home, strict=True))
    out[to] = values[tuple(slice(s - low, e - low) for (s, e), (low, _) in zip(span, b.reach, strict=True))]
    return lambda o: out[tuple(slice(radius + k, radius + k + hi - lo) for k, (lo, hi) in zip(o, b.home, strict=True))]


def rank_among(offsets: list[tuple[int, int, int]], radius: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """e: the share of the voxels at ``offsets`` that are at most as bright, of 255; those that are absent do not count."""

    def run(b: Block) -> dict[str, np.ndarray]:
        value, there = _shifted(b, b.value, radius), _shifted(b, b.there, radius)
        here = b.here(b.value)
        rank, total = np.zeros_like(here), np.zeros_like(here)
        for o in offsets:
            rank += there(o) & (value(o) <= here)
            total += there(o)
        return {"e": 255 * rank // np.maximum(total, 1)}

    return run


DIFFERING = {"v": "long", "n": "long", "d2": "long", "sz": "long", "sy": "long", "sx": "long"}


def differing(radius: int) -> Callable[[Block], dict[str, np.ndarray]]:
    """v, n, d2, sz, sy, sx: the own value; how many voxels of another value are nearest in the cube of ``radius``, their squared distance and the sum of their offsets; all zero without any."""
    span = range(-radius, radius + 1)
    shells: dict[int, list[tuple[int, int, int]]] = {}
    for o in ((z, y, x) for z in span for y in span for x in span if (z, y, x) != (0, 0, 0)):
        shells.setdefault(sum(k * k for k in o), []).append(o)

    def run(b: Block) -> dict[str, np.ndarray]:
        value, there = _shifted(b, b.value, radius), _shifted(b, b.there, radius)
        here = b.here(b.value)
        out = {k: here if k == "v" else np.zeros_like(here) for k in DIFFERING}
        open_ = b.here(b.there)
        for d2, offsets in sorted(shells.items()):
            if not open_.any():
                break
            found = {k: np.zeros(here.shape, np.int16) for k in ("n", "sz", "sy", "sx")}
            for o in offsets:
                other = there(o) & (value(o) != here)
                found["n"] += other
                for a, k in zip(AXES, o, strict=True):
                    if k:
                        found[f"s{a}"] += np.int16(k) * other
            at = open_ & (found["n"] > 0)
            out["d2"][at] = d2
            for k, v in found.items():
                out[k][at] = v[at]
            open_ = open_ & ~at
        return out

    return run
