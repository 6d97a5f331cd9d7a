"""Filters of wide stencils over the volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import halo as H
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
EXT = "e AS (SELECT min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z)-min(z)+1 AS nz, max(y)-min(y)+1 AS ny, max(x)-min(x)+1 AS nx FROM vox), r AS (SELECT z-z0 AS z, y-y0 AS y, x-x0 AS x, v, g, e.* FROM vox, e)"


def _back(place: str, size: str, again: int = 1) -> str:
    """A place mirrored at both ends, as halo.mirrored does it."""
    p = f"abs({place})"
    return f"greatest(0,least({size}-1,CASE WHEN {p}>={size} THEN 2*{size}-{p}-{2 - again} ELSE {p} END))"


def _pass(name: str, source: str, axis: str, width: int) -> str:
    others = [a for a in "zyx" if a != axis]
    on = " AND ".join(f"b.{a}=a.{a}" for a in others)
    return f"{name} AS (SELECT a.z,a.y,a.x,any_value(a.nz) AS nz,any_value(a.ny) AS ny,any_value(a.nx) AS nx,CAST(sum(w*coalesce(b.g,0))//{1 << (width - 1)} AS BIGINT) AS g FROM {source} a CROSS JOIN k LEFT JOIN {source} b ON {on} AND b.{axis}={_back(f'(a.{axis}+o)', f'a.n{axis}')} GROUP BY 1,2,3)"


WIDTH = 11
ROW = ",".join(f"({o - WIDTH // 2},{w})" for o, w in enumerate(H.pascal(WIDTH)))


@C.add("vox", f"{EXT}, k AS (SELECT * FROM (VALUES {ROW}) t(o,w)), {_pass('px', 'r', 'x', WIDTH)}, {_pass('py', 'px', 'y', WIDTH)}, {_pass('pz', 'py', 'z', WIDTH)};; SELECT pz.z+z0 AS z, pz.y+y0 AS y, pz.x+x0 AS x, g AS s FROM pz, e")
def gaussian_axes(spark, d):
    """The grey volume smoothed by a Pascal row of eleven along each axis."""
    return H.stencil(V.voxels(spark, d), "g", "s", WIDTH // 2, H.gaussian_axes(WIDTH))


#: The volume is eight wide in y and x, so the windows take all of both and slices can be counted once for each grey.
@C.add("vox", f"""{EXT}, h AS (SELECT z, t.g AS g, count(*) FILTER (r.g<=t.g) AS k, count(*) AS n FROM r CROSS JOIN range(256) t(g) GROUP BY 1,2),
 n AS (SELECT a.z,a.y,a.x,sum(b.n) AS n,sum(b.k) AS k FROM r a CROSS JOIN range(13) o(i) JOIN h b ON b.g=a.g AND b.z=greatest(0,least(a.z-6,a.nz-13))+i GROUP BY 1,2,3);;
 SELECT z+z0 AS z, y+y0 AS y, x+x0 AS x, CAST(least(255,256*k//n) AS BIGINT) AS e FROM n, e""")
def equalise_cube(spark, d):
    """Each voxel's rank in a window of 13 along every axis, which is moved inside at the borders."""
    return H.stencil(V.voxels(spark, d), "g", "e", 6, H.equalised(6))


CUBE = [(z, y, x, round(w * 1_000_000)) for z, y, x, w in g.gaussian(2, 0.8)]


@C.add("vox", f"""{EXT}, k AS (SELECT * FROM (VALUES {",".join(map(str, CUBE))}) t(dz,dy,dx,w)),
 s AS (SELECT a.z,a.y,a.x,sum(w*coalesce(b.g,0))//1000000 AS s FROM r a CROSS JOIN k LEFT JOIN r b ON b.z={_back('(a.z+dz)', 'a.nz')} AND b.y={_back('(a.y+dy)', 'a.ny')} AND b.x={_back('(a.x+dx)', 'a.nx')} GROUP BY 1,2,3);;
 SELECT z+z0 AS z, y+y0 AS y, x+x0 AS x, CAST(s AS BIGINT) AS s FROM s, e""")
def gaussian_cube_wide(spark, d):
    """A Gaussian of 125 points, in micro-units, mirrored at the borders."""
    return H.stencil(V.voxels(spark, d), "g", "s", 2, H.weighted_cube(CUBE, 1_000_000))


@C.add("vox", f"""{EXT}, o AS (SELECT dz,dy,dx FROM range(-3,4) a(dz), range(-3,4) b(dy), range(-3,4) c(dx)),
 s AS (SELECT a.z,a.y,a.x,count(*) AS n,sum(dz) AS sz,sum(dy) AS sy,sum(dx) AS sx FROM r a CROSS JOIN o JOIN r b ON b.v=255 AND b.z={_back('(a.z+dz)', 'a.nz', 0)} AND b.y={_back('(a.y+dy)', 'a.ny', 0)} AND b.x={_back('(a.x+dx)', 'a.nx', 0)} WHERE a.v=255 GROUP BY 1,2,3),
 f AS (SELECT *, CAST(pow(floor(10*sz/n),2)+pow(floor(10*sy/n),2)+pow(floor(10*sx/n),2) AS BIGINT) AS d2 FROM s);;
 SELECT z+z0 AS z, y+y0 AS y, x+x0 AS x, n, d2 FROM f, e WHERE n>=70 AND d2<29""")
def flat_neighbourhood(spark, d):
    """Set voxels in whose 7 x 7 x 7 at least 70 are set, with their centroid within half a voxel or so."""
    vox = V.voxels(spark, d)
    f = H.stencil(vox.where("v is not null"), "v", "n", 3, H.flatness(3), {"n": "long", "d2": "long"})
    return f.join(vox.where("v = 255").select("z", "y", "x"), ["z", "y", "x"], "left_semi").where((F.col("n") >= 70) & (F.col("d2") < 29)).select("z", "y", "x", "n", "d2")
