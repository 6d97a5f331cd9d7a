"""Queries of alignment, crowded cells, overlap walks, raster folders and test sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import align
from lamina.plans.catalog import Catalog
from lamina.plans.joins import D3, NEAR
from lamina.plans.voxels import NORMAL
from lamina.sources import raster_files, sheets
from lamina.sources import views as V
from lamina.sources.scratch import new_folder

C = Catalog()
R = lambda c, n=6: F.round(c, n)


@C.add("rel pp", """m AS (SELECT p1,p2,qx AS x0,qy AS y0, round(a*(qx-c)+d*(qy-f),3)+CASE WHEN (qx*7+qy*13+p1)%9=0 THEN 7+qy%5 ELSE 0 END AS x1, round(b*(qx-c)+e*(qy-f),3)-CASE WHEN (qx*7+qy*13+p1)%9=0 THEN 5+qx%4 ELSE 0 END AS y1,
   (qx*7919+qy*104729+p1*1299709+p2*15485863)%1000003 AS draw FROM rel JOIN pp ON pid=p1),
 o AS (SELECT *, lead(x0) OVER w-x0 AS dx0, lead(y0) OVER w-y0 AS dy0, lead(x1) OVER w-x1 AS dx1, lead(y1) OVER w-y1 AS dy1 FROM m WINDOW w AS (PARTITION BY p1,p2 ORDER BY draw,x0,y0,x1,y1)),
 k AS (SELECT *, x0+dx0/2 AS mx0, y0+dy0/2 AS my0, x1+dx1/2 AS mx1, y1+dy1/2 AS my1 FROM o WHERE dx0 IS NOT NULL AND sqrt(dx1*dx1+dy1*dy1)>12 AND abs(sqrt((dx0*dx0+dy0*dy0)::DOUBLE)/sqrt(dx1*dx1+dy1*dy1)-1)<0.01),
 s AS (SELECT p1,p2,count(*) AS pairs, atan2(sum(dx1*dy0-dy1*dx0),sum(dx1*dx0+dy1*dy0)) AS t, avg(mx0) AS ax0,avg(my0) AS ay0,avg(mx1) AS ax1,avg(my1) AS ay1 FROM k GROUP BY 1,2),
 v AS (SELECT p1,p2, var_pop(mx0-cos(t)*mx1+sin(t)*my1)+var_pop(my0-sin(t)*mx1-cos(t)*my1) AS spread FROM k JOIN s USING (p1,p2) GROUP BY 1,2);;
 SELECT p1,p2,pairs,round(t,6)+0 AS angle, round(ax0-cos(t)*ax1+sin(t)*ay1,5)+0 AS x, round(ay0-sin(t)*ax1-cos(t)*ay1,5)+0 AS y, round(spread,4)+0 AS spread FROM s JOIN v USING (p1,p2)""")
def similarity_rotation(spark, d):
    """Rotation and shift of related patches, found again from matched points of which one in nine is wrong."""
    r, p = V.relations(spark, d), V.patch_points(spark, d).select(F.col("pid").alias("p1"), "qx", "qy")
    a, b, c, dd, e, f = g.cols("a b c d e f")
    m = r.join(p, "p1")
    wrong = (F.col("qx") * 7 + F.col("qy") * 13 + F.col("p1")) % 9 == 0
    x, y = F.col("qx") - c, F.col("qy") - f
    draw = (F.col("qx") * 7919 + F.col("qy") * 104729 + F.col("p1") * 1299709 + F.col("p2") * 15485863) % 1000003
    m = m.select(
        "p1", "p2", F.col("qx").alias("x0"), F.col("qy").alias("y0"), (R(a * x + dd * y, 3) + F.when(wrong, 7 + F.col("qy") % 5).otherwise(0)).alias("x1"),
        (R(b * x + e * y, 3) - F.when(wrong, 5 + F.col("qx") % 4).otherwise(0)).alias("y1"), draw.alias("draw"),
    )
    s = align.similarity(m, 12)
    return s.select("p1", "p2", "pairs", *((R(c, n) + F.lit(0)).alias(c) for c, n in (("angle", 6), ("x", 5), ("y", 5), ("spread", 4))))


MATCH_SQL = NEAR.format(s=8, left="pp", right="pp") + f""", n AS (SELECT l.pid AS p1,l.qx AS x0,l.qy AS y0,l.vx AS lx,l.vy AS ly,l.vz AS lz,r.pid AS p2,r.qx AS rx,r.qy AS ry,r.vx AS ux,r.vy AS uy,r.vz AS uz, row_number() OVER (PARTITION BY l.pid,l.qx,l.qy,r.pid ORDER BY {D3.format('l', 'r')},r.qx,r.qy) AS k
   FROM l JOIN r USING (i,j,k) WHERE l.pid<>r.pid AND {D3.format('l', 'r')}<8),
 t AS (SELECT a.p1,a.p2,a.x0,a.y0,a.rx AS xa,a.ry AS ya,b.rx AS xb,b.ry AS yb,c.rx AS xc,c.ry AS yc,
   ((b.ux-a.ux)*(a.lx-a.ux)+(b.uy-a.uy)*(a.ly-a.uy)+(b.uz-a.uz)*(a.lz-a.uz))/16.0::DOUBLE AS s, ((c.ux-a.ux)*(a.lx-a.ux)+(c.uy-a.uy)*(a.ly-a.uy)+(c.uz-a.uz)*(a.lz-a.uz))/16.0::DOUBLE AS u
   FROM n a JOIN n b ON b.p1=a.p1 AND b.p2=a.p2 AND b.x0=a.x0 AND b.y0=a.y0 AND b.k=2 JOIN n c ON c.p1=a.p1 AND c.p2=a.p2 AND c.x0=a.x0 AND c.y0=a.y0 AND c.k=3 WHERE a.k=1),
 match AS (SELECT p1,p2,x0,y0, xa+s*(xb-xa)+u*(xc-xa) AS x1, ya+s*(yb-ya)+u*(yc-ya) AS y1 FROM t WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND ((xa=xb AND ya=yc AND ya<>yb AND xa<>xc) OR (ya=yb AND xa=xc AND xa<>xb AND ya<>yc)))"""


@C.add("pp", MATCH_SQL + ";; SELECT p1,p2,x0,y0,round(x1,6) AS x1,round(y1,6) AS y1 FROM match")
def surface_matches(spark, d):
    """Where mesh points lie on the meshes of other patches, from the three nearest points of each."""
    return align.surface_matches(V.patch_points(spark, d)).select("p1", "p2", "x0", "y0", R("x1").alias("x1"), R("y1").alias("y1"))


@C.add("pp", MATCH_SQL + """, m AS (SELECT *, (x0*7919+y0*104729+p1*1299709+p2*15485863)%1000003 AS draw FROM match),
 o AS (SELECT *, lead(x0) OVER w-x0 AS dx0, lead(y0) OVER w-y0 AS dy0, lead(x1) OVER w-x1 AS dx1, lead(y1) OVER w-y1 AS dy1 FROM m WINDOW w AS (PARTITION BY p1,p2 ORDER BY draw,x0,y0,x1,y1)),
 k AS (SELECT *, x0+dx0/2 AS mx0, y0+dy0/2 AS my0, x1+dx1/2 AS mx1, y1+dy1/2 AS my1 FROM o WHERE dx0 IS NOT NULL AND sqrt(dx1*dx1+dy1*dy1)>6 AND abs(sqrt((dx0*dx0+dy0*dy0)::DOUBLE)/sqrt(dx1*dx1+dy1*dy1)-1)<0.02),
 s AS (SELECT p1,p2,count(*) AS pairs, atan2(sum(dx1*dy0-dy1*dx0),sum(dx1*dx0+dy1*dy0)) AS t, avg(mx0) AS ax0,avg(my0) AS ay0,avg(mx1) AS ax1,avg(my1) AS ay1 FROM k GROUP BY 1,2);;
 SELECT p1,p2,pairs,round(t,5)+0 AS angle, round(ax0-cos(t)*ax1+sin(t)*ay1,4)+0 AS x, round(ay0-sin(t)*ax1-cos(t)*ay1,4)+0 AS y FROM s""")
def patch_alignment(spark, d):
    """Rotation and shift between all patches that lie on one another, from their surface matches."""
    draw = (F.col("x0") * 7919 + F.col("y0") * 104729 + F.col("p1") * 1299709 + F.col("p2") * 15485863) % 1000003
    s = align.similarity(align.surface_matches(V.patch_points(spark, d)).withColumn("draw", draw), 6, 0.02)
    return s.select("p1", "p2", "pairs", *((R(c, n) + F.lit(0)).alias(c) for c, n in (("angle", 5), ("x", 4), ("y", 4))))


GOOD_SQL = "good AS (SELECT DISTINCT least(p1,p2) AS a, greatest(p1,p2) AS b FROM edge WHERE w<=4)"


@C.add("pp pg edge", NORMAL + f""", {GOOD_SQL}, pn AS (SELECT pg.*, coalesce(x/l,0) AS nx, coalesce(y/l,0) AS ny, coalesce(z/l,0) AS nz FROM pg LEFT JOIN m USING (pid,qx,qy));;
 SELECT gx,gy,count(*) AS pairs, round(max(greatest(abs((i.vx-j.vx)*i.nx+(i.vy-j.vy)*i.ny+(i.vz-j.vz)*i.nz),abs((i.vx-j.vx)*j.nx+(i.vy-j.vy)*j.ny+(i.vz-j.vz)*j.nz))),5) AS worst
 FROM pn i JOIN pn j USING (gx,gy) WHERE i.pid<j.pid AND NOT EXISTS (SELECT 1 FROM good WHERE a=i.pid AND b=j.pid) GROUP BY 1,2""")
def cell_normal_distances(spark, d):
    """In each cell the greatest distance along the normals between two patches that are not known to fit."""
    good = V.edges(spark, d).where("w <= 4").select(F.col("p1").alias("a"), F.col("p2").alias("b"))
    return align.placed_distances(V.placed_points(spark, d, True), good).select("gx", "gy", "pairs", R("worst", 5).alias("worst"))


@C.add("rel pp", """x AS (SELECT pid, min(vx) AS x0, max(vx) AS x1, min(vy) AS y0, max(vy) AS y1, min(vz) AS z0, max(vz) AS z1 FROM pp GROUP BY pid),
 f AS (SELECT p1 AS s,p2 AS t,0 AS o,a,b,c,d,e,f FROM rel WHERE p1<>p2 UNION ALL SELECT p2,p1,1,a,d,-(a*c+d*f),b,e,-(b*c+e*f) FROM rel WHERE p1<>p2),
 g AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY s,t ORDER BY o) AS n FROM f) f JOIN x p ON p.pid=s JOIN x q ON q.pid=t WHERE n=1 AND p.x0<=q.x1 AND q.x0<=p.x1 AND p.y0<=q.y1 AND q.y0<=p.y1 AND p.z0<=q.z1 AND q.z0<=p.z1),
 h(start,id,hop) AS (SELECT DISTINCT p1//25*25+1,p1//25*25+1,0 FROM rel UNION SELECT h.start,g.t,hop+1 FROM h JOIN g ON g.s=h.id WHERE hop<25), k AS (SELECT start,id,min(hop) AS level FROM h GROUP BY 1,2),
 v AS (SELECT k.start,k.id,k.level,min(q.id) AS via FROM k JOIN g ON g.t=k.id JOIN k q ON q.start=k.start AND q.id=g.s AND q.level=k.level-1 GROUP BY 1,2,3),
 w(start,id,level,via,a,b,c,d,e,f) AS (SELECT start,id,0,NULL::BIGINT,1.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,1.0::DOUBLE,0.0::DOUBLE FROM k WHERE level=0
  UNION ALL SELECT w.start,v.id,w.level+1,v.via,w.a*g.a+w.b*g.d,w.a*g.b+w.b*g.e,w.a*g.c+w.b*g.f+w.c,w.d*g.a+w.e*g.d,w.d*g.b+w.e*g.e,w.d*g.c+w.e*g.f+w.f FROM w JOIN v ON v.start=w.start AND v.via=w.id AND v.level=w.level+1 JOIN g ON g.s=v.via AND g.t=v.id);;
 SELECT start,id,level,via,round(c,6)+0 AS x,round(f,6)+0 AS y,round(atan2(d,a),6)+0 AS angle FROM w""")
def overlap_walk(spark, d):
    """From the second patch of each block, all patches met over related patches whose boxes overlap, in its frame."""
    r, p = V.relations(spark, d), V.patch_points(spark, d)
    box = p.groupBy("pid").agg(*(f(f"v{a}").alias(f"{a}{k}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))))
    w = align.overlap_walk(r, box, r.select((g.div(F.col("p1"), 25) * 25 + 1).alias("id")).distinct())
    x, y, t = g.placement(g.cols("a b c d e f"))
    return w.select("start", "id", "level", "via", (R(x) + F.lit(0)).alias("x"), (R(y) + F.lit(0)).alias("y"), (R(t) + F.lit(0)).alias("angle"))


@C.add("pp", "SELECT pid, qx, qy, vx::DOUBLE AS vx, vy::DOUBLE AS vy, vz::DOUBLE AS vz, min(vx) OVER w::DOUBLE AS x0, max(vz) OVER w::DOUBLE AS z1 FROM pp WINDOW w AS (PARTITION BY pid)".replace("OVER w::DOUBLE", "OVER w"))
def raster_folders(spark, d):
    """All patches written as raster folders with their box documents, and read again. The folder is written when the query is built."""
    folder = new_folder(spark, "rasters")
    raster_files.write_rasters(V.patch_points(spark, d), folder)
    box = raster_files.read_boxes(spark, folder).select("pid", F.col("x0").cast("long").alias("x0"), F.col("z1").cast("long").alias("z1"))
    return raster_files.read_rasters(spark, folder).join(box, "pid")


@C.add("", """s AS (SELECT s_suppkey AS pid, 4+s_suppkey%9 AS n, s_suppkey%3 AS k FROM supplier), r AS (SELECT pid,n,k,x,z FROM s, range(13) a(x), range(13) b(z) WHERE x<n AND z<n),
 o AS (SELECT pid, x::DOUBLE AS x, (2+x)::DOUBLE AS y, z::DOUBLE AS z FROM r WHERE k=0 UNION ALL SELECT pid,x,z+i,z FROM r, range(2) c(i) WHERE k=1
  UNION ALL SELECT pid, CASE WHEN x<n//2 THEN n//2-sqrt(u*u-(u//2)*(u//2)) ELSE n//2+sqrt(u*u-(u//2)*(u//2)) END, n+u//2, z FROM (SELECT *, abs(n//2-x) AS u FROM r WHERE k=2) WHERE NOT (x>=3*n//10 AND x<7*n//10 AND z>=3*n//10 AND z<7*n//10));;
 SELECT pid, round(x,6) AS x, y, z FROM o""")
def test_sheets(spark, d):
    """A sheet of points for each supplier, of a kind and width that follow from its key."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"))
    kind = F.element_at(F.array(F.lit("slope"), F.lit("double"), F.lit("bent")), (F.col("pid") % 3 + 1).cast("int"))
    return sheets.sheets(s, kind, 4 + F.col("pid") % 9).select("pid", R("x").alias("x"), "y", "z")
