"""Stencils over voxel tables (z, y, x, value).

Small separable filters run as one ordered window per axis, which shuffles once per axis and copies no
row; wide ones, and those of large volumes, run in blocks (halo.py). Others send each voxel to the cells it acts on and sum there, with sums before the shuffle.
Missing voxels count as absent, not as zero, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.geometry import cell
from lamina.operators import halo

AXES = ("z", "y", "x")
WORD = 64
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def line(axis: str):
    return Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis)


def along(df: DataFrame, axis: str, out: str, value: str, weights: dict[int, float]) -> DataFrame:
    """Weighted sum of the neighbours along one axis, mirrored at the ends (the neighbour on the other side stands in)."""
    w = line(axis)
    total: Column | None = None
    for o, k in sorted(weights.items()):
        here = F.col(value) if o == 0 else F.coalesce(F.lag(value, -o).over(w), F.lag(value, o).over(w), F.col(value))
        total = here * k if total is None else total + here * k
    return df.withColumn(out, total)


def scatter(vox: DataFrame, stencil: Iterable[tuple[int, int, int]], payload: list[Column]) -> DataFrame:
    """Each voxel's payload sent to the cells z + dz, y + dy, x + dx of a stencil, with the offsets oz, oy, ox of the sender."""
    steps = F.array(*(F.struct(*(F.lit(v).cast("long").alias(f"o{a}") for a, v in zip(AXES, o, strict=True))) for o in stencil))
    out = vox.select("z", "y", "x", *payload, F.explode(steps).alias("o"))
    return out.select(*((F.col(a) + F.col(f"o.o{a}")).alias(a) for a in AXES), *(F.col(f"o.o{a}").alias(f"o{a}") for a in AXES), *(c for c in out.columns if c not in (*AXES, "o")))


def neighbours(radius: int, centre: bool = True) -> list[tuple[int, int, int]]:
    span = range(-radius, radius + 1)
    return [(z, y, x) for z in span for y in span for x in span if centre or (z, y, x) != (0, 0, 0)]


def dilate(vox: DataFrame, value: str, on: Column, allowed: Column) -> DataFrame:
    """One step of growth into face neighbours: adds ``grown``, true where set or where allowed and a neighbour is set."""
    sent = scatter(vox.where(on), FACES, []).select("z", "y", "x").distinct().withColumn("_near", F.lit(True))
    return vox.join(sent, list(AXES), "left").withColumn("grown", on | (allowed & F.coalesce("_near", F.lit(False)))).drop("_near")


def dilated_sets(points: DataFrame, key: str) -> DataFrame:
    """(key, x, y, z): the points of each set with all around them (cubes of 27), each once; repeated points count once.

    A point goes to the tiles of 64 cubed that its cube reaches, where a line along z is one word of bits. So the rows are shuffled
    once, with the margins, and what grows stays in its tile; a set is as many tasks as it has tiles.
    """
    rows = points.select(key, "x", "y", "z").dropna()
    for a, tile in (("x", "_i"), ("y", "_j"), ("z", "_k")):
        rows = rows.withColumn(tile, F.explode(F.sequence(cell(F.col(a) - 1, WORD), cell(F.col(a) + 1, WORD))))
    tiles = [key, "_i", "_j", "_k"]
    # the bits of z - 1, z and z + 1 that lie in the word
    at = rows.withColumn("_z", (F.col("z") - F.col("_k") * WORD).cast("int"))
    bits = F.expr("if(_z > 0, shiftleft(7L, _z - 1), shiftright(7L, 1 - _z))")
    lines = at.select(*tiles, "x", "y", bits.alias("_m")).repartition(*tiles).groupBy(*tiles, "x", "y").agg(F.bit_or("_m").alias("_m"))
    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = lines.withColumn("_o", F.explode(steps)).select(*tiles, (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y"), "_m")
    spread = spread.where((cell(F.col("x"), WORD) == F.col("_i")) & (cell(F.col("y"), WORD) == F.col("_j")))
    full = spread.groupBy(*tiles, "x", "y").agg(F.bit_or("_m").alias("_m")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))
    return full.where("shiftright(_m, _b) & 1 = 1").select(key, "x", "y", (F.col("_k") * WORD + F.col("_b")).alias("z"))


def direction_field(vox: DataFrame, radius: int = 2) -> DataFrame:
    """(z, y, x, v, fx, fy, fz): mean unit vector to the nearest voxels of another value, turned round inside the surface.

    Voxels beyond the table count as absent. Cells without a different voxel within the radius have no row.
    """
    near = halo.stencil(vox, "v", "d", radius, halo.differing(radius), halo.DIFFERING).where("n > 0")
    sign = F.when(F.col("v") == 0, 1.0).otherwise(-1.0)
    return near.select("z", "y", "x", "v", *((sign * F.col(f"s{a}") / F.sqrt(F.col("d2").cast("double")) / F.col("n")).alias(f"f{a}") for a in ("x", "y", "z")))
