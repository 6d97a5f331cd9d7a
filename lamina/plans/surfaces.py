"""Queries on sheets: neighbouring sets, points near a patch, positions and normals inside quads, forces, crops and rays."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import spatial as S
from lamina.operators.mesh import gathered, normals
from lamina.operators.sets import common_counts, shared_places
from lamina.plans.catalog import Catalog
from lamina.plans.voxels import NORMAL
from lamina.sources import text_tables as T
from lamina.sources import views as V
from lamina.sources.scratch import new_folder

C = Catalog()
R = lambda c, n=6: F.round(c, n)
XYZ = ["x", "y", "z"]
MARGIN = 8
RADIUS = 100
SPRING = 0.02
ROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


@C.add("pp", f"""b AS (SELECT min(vx) AS x0, max(vx) AS x1, min(vy) AS y0, max(vy) AS y1, min(vz) AS z0, max(vz) AS z1 FROM pp);;
 SELECT pid,qx,qy,vx,vy,vz FROM pp, b WHERE vx BETWEEN x0+{MARGIN} AND x1-{MARGIN} AND vy BETWEEN y0+{MARGIN} AND y1-{MARGIN} AND vz BETWEEN z0 AND z1""")
def inside_margin(spark, d):
    """Points at least a margin inside the volume's sides; the box is that of all points and goes into the filter as one scalar. Heights have no margin, as the sheet is thin."""
    pp = V.patch_points(spark, d)
    box = pp.agg(F.struct(*(f(f"v{a}").alias(f"{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max)))).alias("b")).scalar()
    inside = F.lit(True)
    for a, m in (("x", MARGIN), ("y", MARGIN), ("z", 0)):
        inside = inside & F.col(f"v{a}").between(box[f"{a}0"] + m, box[f"{a}1"] - m)
    return pp.where(inside).select("pid", "qx", "qy", "vx", "vy", "vz")


@C.add("rel", "SELECT p1, p2 FROM rel")
def alignment_edges(spark, d):
    """The two patches of each line of an alignment list (fields 0 and 2); a header, short lines and lines without numbers are passed over."""
    r, folder = V.relations(spark, d), new_folder(spark, "alignments")
    T.write_fields(r.select("p1", F.lit(20).alias("radius"), "p2", *"abcdef"), folder, " ")
    odd = r.select("p1").distinct()
    T.write_fields(odd.select(F.lit("patch"), F.lit("radius"), F.lit("other")), folder, " ")
    T.write_fields(odd.select("p1", F.lit(20)), folder, " ")
    lines = T.fields(spark.read.text(folder), ["p1", "radius", "p2"], r"\s+", exact=False)
    return lines.select(F.col("p1").cast("long").alias("p1"), F.col("p2").cast("long").alias("p2"))


@C.add("pp", """c AS (SELECT pid, CAST(floor(qx/2.0) AS BIGINT) AS i, CAST(floor(qy/2.0) AS BIGINT) AS j, CAST(trunc(avg(vx)) AS BIGINT) AS x, CAST(trunc(avg(vy)) AS BIGINT) AS y, CAST(trunc(avg(vz)) AS BIGINT) AS z FROM pp GROUP BY 1,2,3);;
 SELECT x,y,z,count(*) AS n,count(DISTINCT pid) AS patches,min(pid) AS first FROM c GROUP BY 1,2,3 HAVING count(*)>1""")
def coinciding_centres(spark, d):
    """Places where the centres of several pieces (of two by two mesh points) fall, cut to whole numbers."""
    pp = V.patch_points(spark, d)
    pieces = pp.groupBy("pid", g.cell(F.col("qx"), 2).alias("i"), g.cell(F.col("qy"), 2).alias("j")).agg(*(F.avg(f"v{a}").cast("long").alias(a) for a in XYZ))
    return pieces.groupBy(*XYZ).agg(F.count("*").alias("n"), F.countDistinct("pid").alias("patches"), F.min("pid").alias("first")).where("n > 1")


@C.add("edge pp", f"""t AS (SELECT p1, p2, vx AS tx, vy AS ty, vz AS tz FROM edge JOIN pp ON pid=p1 AND qx=0 AND qy=0 WHERE p1<>p2),
 n AS (SELECT p1, p2, qx, qy, sqrt(((vx-tx)*(vx-tx)+(vy-ty)*(vy-ty)+(vz-tz)*(vz-tz))::DOUBLE) AS dist FROM t JOIN pp ON pid=p2);;
 SELECT p1,p2,qx,qy,row_number() OVER (PARTITION BY p1,p2 ORDER BY dist,qx,qy) AS rank, round(dist,6) AS dist FROM n WHERE dist<{RADIUS}""")
def near_points_of_patch(spark, d):
    """For each relation the second patch's points within a radius of the first one's centre, nearest first; ties by mesh position.

    Points meet targets by patch and cell, so a large patch is not read as one group.
    """
    pp = V.patch_points(spark, d)
    cells = ["c0", "c1", "c2"]
    centre = pp.where("qx = 0 and qy = 0").select(F.col("pid").alias("p1"), *(F.col(f"v{a}").alias(f"t{a}") for a in XYZ))
    target = V.edges(spark, d).where("p1 <> p2").select("p1", "p2").join(centre, "p1")
    target = S.around(S.with_cells(target, "tx ty tz", RADIUS), 3)
    points = S.with_cells(pp.withColumnRenamed("pid", "p2"), "vx vy vz", RADIUS)
    near = points.join(target, ["p2", *cells]).withColumn("dist", g.distance(g.cols("vx vy vz"), g.cols("tx ty tz"))).where(F.col("dist") < RADIUS)
    rank = F.row_number().over(Window.partitionBy("p1", "p2").orderBy("dist", "qx", "qy"))
    return near.select("p1", "p2", "qx", "qy", rank.cast("long").alias("rank"), R("dist").alias("dist"))


PLACE = "10.0::DOUBLE*(pid%32)", "10.0::DOUBLE*(pid//32)", "(pid%8)*pi()/4"
QUAD = f"""{NORMAL}, f AS (SELECT pp.pid,pp.qx,pp.qy,vx,vy,vz,x/l AS nx,y/l AS ny,z/l AS nz FROM pp JOIN m USING (pid,qx,qy)), s AS (SELECT pid, greatest(max(abs(qx)),max(abs(qy))) AS radius FROM pp GROUP BY pid),
 k AS (SELECT pid,qx,qy,{PLACE[0]} AS x0,{PLACE[1]} AS y0,{PLACE[2]} AS t, qx+((qx+20)%3+1)/4.0::DOUBLE AS u, qy+((qy+20)%3+1)/4.0::DOUBLE AS v FROM pp),
 a AS (SELECT k.*, k.qx AS i, k.qy AS j, u-qx AS fx, v-qy AS fy, x0+u*cos(t)-v*sin(t) AS gx, y0+u*sin(t)+v*cos(t) AS gy FROM k)"""


def _mix_sql(n: str) -> str:
    return f"round((c00.{n}*(1-fx)+c10.{n}*fx)*(1-fy)+(c01.{n}*(1-fx)+c11.{n}*fx)*fy,6)+0 AS {n}"


@C.add("pp", QUAD + ";; SELECT a.pid, round(gx,6)+0 AS gx, round(gy,6)+0 AS gy, " + ", ".join(_mix_sql(n) for n in ("vx", "vy", "vz", "nx", "ny", "nz")) + ", round(greatest(0.0,least(1.0,1-sqrt(u*u+v*v)/radius)),6)+0 AS weight FROM a JOIN s USING (pid)"
 + "".join(f" JOIN f c{i}{j} ON c{i}{j}.pid=a.pid AND c{i}{j}.qx=a.i+{i} AND c{i}{j}.qy=a.j+{j}" for i in (0, 1) for j in (0, 1)))
def surface_at(spark, d):
    """Position, normal and weight of placed patches at global points: undone placement, then bilinear mixing inside quads with four corners.

    A point outside every quad of its patch has no row. The weight falls from 1 at the patch's origin to 0 at its radius.
    """
    pp = V.patch_points(spark, d)
    place = [F.col("pid") % V.COLUMNS * 10.0, g.div(F.col("pid"), V.COLUMNS) * 10.0, F.col("pid") % 8 * math.pi / 4]
    u, v = (F.col(c) + ((F.col(c) + 20) % 3 + 1) / 4.0 for c in ("qx", "qy"))
    gx, gy = g.apply(g.from_placement(*place), u, v)
    asked = pp.select("pid", gx.alias("gx"), gy.alias("gy"))
    xd, yd = g.apply(g.rigid_inverse(g.from_placement(*place)), F.col("gx"), F.col("gy"))
    asked = asked.select("pid", "gx", "gy", xd.alias("xd"), yd.alias("yd")).withColumns({"qx": F.floor("xd").cast("long"), "qy": F.floor("yd").cast("long")})
    values = ["vx", "vy", "vz", "nx", "ny", "nz"]
    corners = gathered(pp.join(normals(pp), ["pid", "qx", "qy"]), [(0, 0), (1, 0), (0, 1), (1, 1)], values)
    corners = corners.where(" and ".join(f"vx_{k} is not null" for k in range(4)))
    radius = pp.groupBy("pid").agg(F.greatest(F.max(F.abs("qx")), F.max(F.abs("qy"))).alias("radius"))
    fx, fy = F.col("xd") - F.col("qx"), F.col("yd") - F.col("qy")
    mix = lambda n: (F.col(f"{n}_0") * (1 - fx) + F.col(f"{n}_1") * fx) * (1 - fy) + (F.col(f"{n}_2") * (1 - fx) + F.col(f"{n}_3") * fx) * fy
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(g.length([F.col("xd"), F.col("yd")]), F.col("radius"))))
    out = asked.join(corners, ["pid", "qx", "qy"]).join(radius, "pid")
    rounded = {"gx": F.col("gx"), "gy": F.col("gy"), **{n: mix(n) for n in values}, "weight": weight}
    return out.select("pid", *((R(c) + F.lit(0)).alias(n) for n, c in rounded.items()))


@C.add("pp", f"""e AS (SELECT a.pid,a.qx,a.qy, a.vx-b.vx AS x, a.vy-b.vy AS y, a.vz-b.vz AS z, 4*sqrt(((a.qx-b.qx)*(a.qx-b.qx)+(a.qy-b.qy)*(a.qy-b.qy))::DOUBLE) AS rest
 FROM pp a LEFT JOIN pp b ON a.pid=b.pid AND b.qx BETWEEN a.qx-1 AND a.qx+1 AND b.qy BETWEEN a.qy-1 AND a.qy+1 AND (a.qx<>b.qx OR a.qy<>b.qy)),
 f AS (SELECT pid,qx,qy,x,y,z,(rest-sqrt((x*x+y*y+z*z)::DOUBLE))/sqrt((x*x+y*y+z*z)::DOUBLE) AS k FROM e),
 s AS (SELECT pid,qx,qy,coalesce(sum(x*k),0) AS x,coalesce(sum(y*k),0) AS y,coalesce(sum(z*k),0) AS z FROM f GROUP BY 1,2,3);;
 SELECT pid, count(*) AS n, round(max({SPRING}*sqrt(x*x+y*y+z*z)),6)::DOUBLE AS most FROM s GROUP BY pid""")
def largest_force(spark, d):
    """The greatest spring force on any point of each patch, from its eight mesh neighbours; a measure of how far a sheet is from rest.

    Points without neighbours have none; a neighbour at the same place gives no direction and is passed over.
    """
    near = gathered(V.patch_points(spark, d), [(0, 0), *ROUND], ["vx", "vy", "vz"]).where("vx_0 is not null")
    own = [F.col(f"v{a}_0") for a in XYZ]
    total = [F.lit(0.0)] * 3
    for k, (i, j) in enumerate(ROUND, 1):
        way = g.sub(own, [F.col(f"v{a}_{k}") for a in XYZ])
        pull = F.coalesce(F.try_divide(4 * math.hypot(i, j) - g.length(way), g.length(way)), F.lit(0.0))
        total = [t + F.coalesce(w * pull, F.lit(0.0)) for t, w in zip(total, way, strict=True)]
    return near.groupBy("pid").agg(F.count("*").alias("n"), R(F.max(SPRING * g.length(total))).alias("most"))


@C.add("pp", """e AS (SELECT pid, min(qx) AS x0, min(qy) AS y0, max(qx)-min(qx)+1 AS w, max(qy)-min(qy)+1 AS h FROM pp GROUP BY pid),
 b AS (SELECT *, greatest(0,least(pid%5-2,w)) AS l, greatest(0,least(pid%7-3,h)) AS t, greatest(0,least(pid%5+22,w)) AS r, greatest(0,least(pid%7+50,h)) AS u FROM e);;
 SELECT pid, qx-x0-l AS col, qy-y0-t AS row, vz AS value FROM pp JOIN b USING (pid) WHERE qx-x0>=l AND qx-x0<r AND qy-y0>=t AND qy-y0<u""")
def raster_crop(spark, d):
    """Each patch's raster cut to a box of its own, which is clipped to the raster first; a box that is empty then leaves no row."""
    pp = V.patch_points(spark, d)
    e = pp.groupBy("pid").agg(F.min("qx").alias("x0"), F.min("qy").alias("y0"), (F.max("qx") - F.min("qx") + 1).alias("w"), (F.max("qy") - F.min("qy") + 1).alias("h"))
    clip = lambda c, size: F.greatest(F.lit(0), F.least(c, F.col(size)))
    p5, p7 = F.col("pid") % 5, F.col("pid") % 7
    box = e.select("pid", "x0", "y0", clip(p5 - 2, "w").alias("l"), clip(p7 - 3, "h").alias("t"), clip(p5 + 22, "w").alias("r"), clip(p7 + 50, "h").alias("u"))
    col, row = F.col("qx") - F.col("x0"), F.col("qy") - F.col("y0")
    cut = pp.join(box, "pid").where((col >= F.col("l")) & (col < F.col("r")) & (row >= F.col("t")) & (row < F.col("u")))
    return cut.select("pid", (col - F.col("l")).alias("col"), (row - F.col("t")).alias("row"), F.col("vz").alias("value"))


@C.add("vox", """f AS (SELECT z, x, max(y) AS y FROM vox WHERE v=255 GROUP BY 1,2), m AS (SELECT max(y) AS top FROM vox), s AS (SELECT f.z, f.x, f.y AS hit, least(greatest(f.y+o,0),top) AS y FROM f, m, range(-1,2) t(o));;
 SELECT s.z, s.x, hit AS y, CAST(sum(coalesce(g,0))//3 AS BIGINT) AS shade FROM s LEFT JOIN vox ON vox.z=s.z AND vox.y=s.y AND vox.x=s.x GROUP BY 1,2,3""")
def ray_shade(spark, d):
    """The first set voxel of each ray from the top, shaded by the mean grey of three voxels from one below it on.

    Places beyond the volume repeat its border. Only the places asked for meet the volume, not whole rays.
    """
    vox = V.voxels(spark, d)
    top = vox.agg(F.max("y")).scalar()
    hit = vox.where("v = 255").groupBy("z", "x").agg(F.max("y").alias("hit"))
    asked = hit.withColumn("o", F.explode(F.array(*(F.lit(o).cast("long") for o in (-1, 0, 1))))).withColumn("y", F.least(F.greatest(F.col("hit") + F.col("o"), F.lit(0)), top))
    shades = asked.join(vox.select("z", "y", "x", "g"), ["z", "y", "x"], "left").groupBy("z", "x", "hit").agg(F.sum(F.coalesce("g", F.lit(0))).alias("t"))
    return shades.select("z", "x", F.col("hit").alias("y"), g.div(F.col("t"), 3).alias("shade"))


COMMON = """c AS (SELECT a.file AS a, b.file AS b, count(*) AS common FROM strip a JOIN strip b USING (x,y,z) WHERE a.file<b.file GROUP BY 1,2), q AS (SELECT DISTINCT file,x,z FROM strip)"""


@C.add("strip", COMMON + """, g AS (SELECT DISTINCT file,x,z FROM strip WHERE (x,y,z) IN (SELECT x,y,z FROM strip GROUP BY 1,2,3 HAVING count(*)>1)), k AS (SELECT * FROM q EXCEPT SELECT * FROM g),
 p AS (SELECT l.file AS a, r.file AS b, count(*) AS crossing FROM k l JOIN k r USING (x,z) WHERE l.file<r.file GROUP BY 1,2);;
 SELECT a, b, common, coalesce(crossing,0) AS crossing FROM c LEFT JOIN p USING (a,b) WHERE coalesce(crossing,0)<=20*common""")
def plug_neighbours(spark, d):
    """Sets that abut along shared points (plugs), unless they also lie over one another, apart from plugs, in more than 20 times as many columns."""
    s = V.strip_sets(spark, d)
    plugs = shared_places(s, "file", XYZ).select("file", "x", "z").distinct()
    clean = s.select("file", "x", "z").distinct().join(plugs, ["file", "x", "z"], "left_anti")
    both = common_counts(s, "file", XYZ, "common").join(common_counts(clean, "file", ["x", "z"], "crossing"), ["a", "b"], "left")
    return both.select("a", "b", "common", F.coalesce("crossing", F.lit(0)).alias("crossing")).where("crossing <= 20 * common")


@C.add("strip", COMMON + """, p AS (SELECT l.file AS a, r.file AS b, count(*) AS flat FROM q l JOIN q r USING (x,z) WHERE l.file<r.file GROUP BY 1,2);;
 SELECT a, b, common, flat FROM c JOIN p USING (a,b) WHERE common>20 AND flat<=2*common""")
def volume_neighbours(spark, d):
    """Sets of one volume with more than 20 points in common and at most twice as many columns."""
    s = V.strip_sets(spark, d)
    both = common_counts(s, "file", XYZ, "common").join(common_counts(s, "file", ["x", "z"], "flat"), ["a", "b"])
    return both.where("common > 20 and flat <= 2 * common")
