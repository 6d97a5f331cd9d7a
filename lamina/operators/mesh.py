"""Mesh operators on patch points (pid, qx, qy, vx, vy, vz).

Neighbours arrive by sending each point to the places around it, so one shuffle on (pid, qx, qy)
gathers a whole stencil.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g


def gathered(points: DataFrame, steps: list[tuple[int, int]], values: list[str]) -> DataFrame:
    """(pid, qx, qy) and, for each step k, <value>_k of the point at (qx, qy) + step; null where there is none."""
    o = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for k, (i, j) in enumerate(steps)))
    sent = points.withColumn("o", F.explode(o)).select("pid", (F.col("qx") - F.col("o.i")).alias("qx"), (F.col("qy") - F.col("o.j")).alias("qy"), F.col("o.k").alias("k"), *values)
    return sent.groupBy("pid", "qx", "qy").agg(*(F.max(F.when(F.col("k") == k, F.col(v))).alias(f"{v}_{k}") for k in range(len(steps)) for v in values))


def normals(points: DataFrame) -> DataFrame:
    """(pid, qx, qy, nx, ny, nz): unit normals where a neighbour exists on both mesh axes; a missing side is replaced by the point itself."""
    near = gathered(points, [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)], ["vx", "vy", "vz"])
    side = lambda k: [F.coalesce(f"v{a}_{k}", f"v{a}_0") for a in "xyz"]
    near = near.where("vx_0 is not null and (vx_1 is not null or vx_2 is not null) and (vx_3 is not null or vx_4 is not null)")
    n = g.normalised(g.cross(g.sub(side(1), side(2)), g.sub(side(3), side(4))))
    return near.select("pid", "qx", "qy", *(c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)))


def upsample(points: DataFrame, values: list[str], factor: int) -> DataFrame:
    """(pid, x, y, values): factor^2 bilinear points for each quad with four corners, on a lattice ``factor`` times as fine."""
    q = gathered(points, [(0, 0), (1, 0), (0, 1), (1, 1)], values).where(" and ".join(f"{values[0]}_{k} is not null" for k in range(4)))
    fine = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(factor) for j in range(factor)))
    q = q.withColumn("o", F.explode(fine))
    u, v = F.col("o.i"), F.col("o.j")
    mix = lambda c: ((factor - u) * (factor - v) * F.col(f"{c}_0") + u * (factor - v) * F.col(f"{c}_1") + (factor - u) * v * F.col(f"{c}_2") + u * v * F.col(f"{c}_3")) / float(factor * factor)
    return q.select("pid", (F.col("qx") * factor + u).alias("x"), (F.col("qy") * factor + v).alias("y"), *(mix(c).alias(c) for c in values))
