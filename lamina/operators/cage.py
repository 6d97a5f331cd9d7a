"""Deformation of points by a cage of triangles.

Triangles are cut into square tiles and points meet them by tile, so no point is compared with all triangles.
A point on an edge or in overlapping triangles belongs to the first triangle of the list, and moves with it:
its barycentric place in the triangle is kept in the moved triangle. Triangles without area hold no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g

CORNERS = "ax ay bx by cx cy"


def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """Twice the signed area of p, q, r; exact for integers."""
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def _edges():
    ax, ay, bx, by, cx, cy = g.cols(CORNERS)
    return [(ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)]


def inside(x: Column, y: Column) -> Column:
    """Whether a point is in the triangle of the columns ax ... cy, its edges included."""
    t = [turn(*e, x, y) for e in _edges()]
    return F.greatest(F.least(*t), -F.greatest(*t)) >= 0


def tiles(triangles: DataFrame, size: int) -> DataFrame:
    """Each triangle once for each tile (tx, ty) that it can touch; tiles beyond one of its edges are left out."""
    box = {}
    for axis in "xy":
        ends = [F.col(f"{p}{axis}") for p in "abc"]
        box[f"t{axis}"] = F.sequence(g.cell(F.least(*ends), size), g.cell(F.greatest(*ends), size))
    t = triangles.where(turn(*g.cols(CORNERS)) != 0)
    t = t.withColumn("tx", F.explode(box["tx"])).withColumn("ty", F.explode(box["ty"]))
    way = F.signum(turn(*g.cols(CORNERS)))
    corners = [((F.col("tx") + i) * size, (F.col("ty") + j) * size) for i in (0, 1) for j in (0, 1)]
    touches = F.lit(True)
    for e in _edges():
        touches = touches & (F.greatest(*(turn(*e, x, y) * way for x, y in corners)) >= 0)
    return t.where(touches)


def deform(points: DataFrame, key: list[str], triangles: DataFrame, size: int, x: str = "x", y: str = "y") -> DataFrame:
    """``key``, tri, u, v: the first triangle that holds each point and where it goes; null outside the cage.

    ``triangles`` has tri (its place in the list), corners ax ... cy and moved corners max ... mcy.
    """
    cut = tiles(triangles, size)
    px, py = F.col(x), F.col(y)
    at = points.select(*key, px.alias("_x"), py.alias("_y"), g.cell(px, size).alias("tx"), g.cell(py, size).alias("ty"))
    hit = at.join(cut.withColumnsRenamed({"tx": "_tx", "ty": "_ty"}), (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty")) & inside(F.col("_x"), F.col("_y")), "left")
    ax, ay, bx, by, cx, cy = g.cols(CORNERS)
    area = turn(ax, ay, bx, by, cx, cy)
    k, l = turn(ax, ay, F.col("_x"), F.col("_y"), cx, cy) / area, turn(ax, ay, bx, by, F.col("_x"), F.col("_y")) / area
    move = lambda c: F.col(f"ma{c}") + k * (F.col(f"mb{c}") - F.col(f"ma{c}")) + l * (F.col(f"mc{c}") - F.col(f"ma{c}"))
    hit = hit.select(*key, F.when(F.col("tri").isNotNull(), F.struct("tri", move("x").alias("u"), move("y").alias("v"))).alias("_m"))
    return hit.groupBy(*key).agg(F.min("_m").alias("_m")).select(*key, "_m.tri", "_m.u", "_m.v")
