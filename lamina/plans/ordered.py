"""Operators whose result depends on an order: writers, runs, rays, interpolation, ranks; and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import halo
from lamina.operators.ranges import running_sum
from lamina.operators.sets import common_counts
from lamina.operators.voxel import AXES, along, dilated_sets, line
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)


@C.add("edge", "SELECT p2 AS p, arg_max(p1, (w,p1)) AS placed_from, max(w) AS ord FROM edge GROUP BY p2")
def last_placed(spark, d):
    """Of several placed neighbours the last one counts."""
    return V.edges(spark, d).groupBy(F.col("p2").alias("p")).agg(F.max_by("p1", F.struct("w", "p1")).alias("placed_from"), F.max("w").alias("ord"))


@C.add("surf", "SELECT x, z, min(file) AS file, arg_min(y, (file,y)) AS y FROM surf GROUP BY x,z")
def first_writer(spark, d):
    return V.point_sets(spark, d).groupBy("x", "z").agg(F.min("file").alias("file"), F.min_by("y", F.struct("file", "y")).alias("y"))


@C.add("pg", "SELECT gx, gy, max(pid) AS pid, arg_max(vz, pid) AS vz FROM pg GROUP BY gx,gy")
def last_writer(spark, d):
    return V.placed_points(spark, d).groupBy("gx", "gy").agg(F.max("pid").alias("pid"), F.max_by("vz", "pid").alias("vz"))


@C.add("vox", """r AS (SELECT *, y-row_number() OVER (PARTITION BY z,x ORDER BY y) AS run FROM vox WHERE v=255);;
 SELECT z,y,x FROM (SELECT *, row_number() OVER (PARTITION BY z,x,run ORDER BY y) AS k FROM r) WHERE k<=2""")
def run_length_cap(spark, d):
    """At most the first two voxels of each run along y: gaps and islands."""
    run = V.voxels(spark, d).where("v = 255").withColumn("run", F.col("y") - F.row_number().over(Window.partitionBy("z", "x").orderBy("y")))
    return run.withColumn("k", F.row_number().over(Window.partitionBy("z", "x", "run").orderBy("y"))).where("k <= 2").select("z", "y", "x")


@C.add("surf", """SELECT file,x,z,max(y) AS y_high,min(y) AS y_low FROM surf GROUP BY 1,2,3""")
def ray_first(spark, d):
    """The first point of each ray along y, from either end."""
    return V.point_sets(spark, d).groupBy("file", "x", "z").agg(F.max("y").alias("y_high"), F.min("y").alias("y_low"))


@C.add("pp", """f AS (SELECT pid, qx, qy, CASE WHEN (qx*7+qy*13)%3=0 THEN NULL ELSE vz END AS v FROM pp),
 n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN qx END IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN qx END IGNORE NULLS) OVER b AS x1, first_value(v IGNORE NULLS) OVER b AS v1 FROM f
  WINDOW a AS (PARTITION BY pid,qy ORDER BY qx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY pid,qy ORDER BY qx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING));;
 SELECT pid,qx,qy, round(CASE WHEN v IS NOT NULL THEN v WHEN x0 IS NULL OR x1 IS NULL THEN NULL ELSE v0+(v1-v0)*(qx-x0)/(x1-x0)::DOUBLE END,6)::DOUBLE AS v FROM n""")
def gap_interpolate(spark, d):
    """Blank mesh points filled linearly between the nearest ones on either side along x."""
    f = V.patch_points(spark, d).withColumn("v", F.when((F.col("qx") * 7 + F.col("qy") * 13) % 3 == 0, None).otherwise(F.col("vz")))
    row = Window.partitionBy("pid", "qy").orderBy("qx")
    back, fore = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("qx"))
    n = f.select("pid", "qx", "qy", "v", F.last(at, True).over(back).alias("x0"), F.last("v", True).over(back).alias("v0"), F.first(at, True).over(fore).alias("x1"), F.first("v", True).over(fore).alias("v1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("qx") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    return n.select("pid", "qx", "qy", R(F.coalesce(F.col("v").cast("double"), between)).alias("v"))


@C.add("pp", """k AS (SELECT * FROM (VALUES (-1000,0),(40,100),(300,60),(900,400),(100000,500)) t(z0,c0)), s AS (SELECT *, lead(z0) OVER (ORDER BY z0) AS z1, lead(c0) OVER (ORDER BY z0) AS c1 FROM k);;
 SELECT pid,qx,qy, round(c0+(c1-c0)*(vx-z0)/(z1-z0)::DOUBLE,6) AS centre FROM pp JOIN s ON vx>=z0 AND vx<z1""")
def centreline_interpolate(spark, d):
    """A piecewise linear centre line; its few control points are constants."""
    knots = [(-1000, 0), (40, 100), (300, 60), (900, 400), (100000, 500)]
    x = F.col("vx")
    out = None
    for (z0, c0), (z1, c1) in zip(knots, knots[1:], strict=False):
        v = c0 + (c1 - c0) * (x - z0) / float(z1 - z0)
        hit = (x >= z0) & (x < z1)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return V.patch_points(spark, d).select("pid", "qx", "qy", R(out).alias("centre"))


@C.add("sample", "SELECT file, round(sum(score*pow(0.85,k)),4) AS heat, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY iter DESC)-1 AS k FROM sample) GROUP BY file")
def heat_decay(spark, d):
    """Heat after the last iteration when each one multiplies what was there by 0.85, in closed form."""
    k = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("iter"))) - 1
    return V.samples(spark, d).withColumn("k", k).groupBy("file").agg(R(F.sum(F.col("score") * F.pow(F.lit(0.85), "k")), 4).alias("heat"), F.count("*").alias("n"))


@C.add("edge", """n AS (SELECT p1, count(*) AS n FROM edge GROUP BY p1);; SELECT p1, n, CAST(coalesce(sum(n) OVER (ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS first FROM n""")
def prefix_offsets(spark, d):
    """Where each vertex's neighbours begin."""
    n = V.edges(spark, d).groupBy("p1").agg(F.count("*").alias("n"))
    return running_sum(n, "p1", F.col("n"), "upto").select("p1", "n", (F.col("upto") - F.col("n")).alias("first"))


@C.add("sample", """SELECT file,iter,score FROM (SELECT *, min(score) OVER (PARTITION BY file ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM sample) WHERE low IS NULL OR score<low""")
def running_minima(spark, d):
    """Samples that are smaller than all before them in their log."""
    w = Window.partitionBy("file").orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)
    return V.samples(spark, d).withColumn("low", F.min("score").over(w)).where("low is null or score < low").select("file", "iter", "score")


@C.add("pp", """SELECT a.pid,a.qx,a.qy, round(a.vz-avg(b.vz),6)+0 AS bump FROM pp a JOIN pp b ON a.pid=b.pid AND b.qx BETWEEN a.qx-1 AND a.qx+1 AND b.qy BETWEEN a.qy-1 AND a.qy+1 GROUP BY a.pid,a.qx,a.qy,a.vz""")
def bumpiness(spark, d):
    """Height above the mean of the 3 x 3 neighbours, each point sending its height to the nine around it."""
    p = V.patch_points(spark, d)
    o = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sent = p.select("pid", "qx", "qy", "vz", F.explode(o).alias("o")).select("pid", (F.col("qx") + F.col("o.i")).alias("qx"), (F.col("qy") + F.col("o.j")).alias("qy"), "vz")
    mean = sent.groupBy("pid", "qx", "qy").agg(F.avg("vz").alias("m"))
    return p.join(mean, ["pid", "qx", "qy"]).select("pid", "qx", "qy", (R(F.col("vz") - F.col("m")) + F.lit(0)).alias("bump"))


@C.add("surf", "SELECT file, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, file) AS place FROM surf GROUP BY file ORDER BY 3 LIMIT 20")
def largest_sets(spark, d):
    top = V.point_sets(spark, d).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "file")).cast("long"))


@C.add("pp", """m AS (SELECT pid,qx,qy, sqrt(((vx-4*qx)*(vx-4*qx)+(vy-4*qy)*(vy-4*qy))::DOUBLE) AS move FROM pp);; SELECT pid,qx,qy,round(move,6) AS move FROM m ORDER BY m.move DESC, pid, qx, qy LIMIT 100""")
def largest_moves(spark, d):
    m = g.length([F.col("vx") - 4 * F.col("qx"), F.col("vy") - 4 * F.col("qy")])
    return V.patch_points(spark, d).withColumn("move", m).orderBy(F.desc("move"), "pid", "qx", "qy").limit(100).select("pid", "qx", "qy", R("move").alias("move"))


@C.add("edge", "SELECT p1,p2,w, row_number() OVER (PARTITION BY p2 ORDER BY p1, w) AS place FROM edge")
def sorted_relations(spark, d):
    return V.edges(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("p2").orderBy("p1", "w")).cast("long"))


@C.add()
def nearest_differing(spark, d):
    """Squared distance to the nearest voxel of another value, within two."""
    near = halo.stencil(V.voxels(spark, d), "v", "d", 2, halo.differing(2), halo.DIFFERING)
    return near.select(*AXES, F.nullif("d2", F.lit(0)).alias("d2"))


C.sql["nearest_differing"] = V.oracle("vox", """o AS (SELECT dz,dy,dx,dz*dz+dy*dy+dx*dx AS d2 FROM range(-2,3) a(dz), range(-2,3) b(dy), range(-2,3) c(dx)),
 m AS (SELECT a.z,a.y,a.x,min(d2) AS d2 FROM (SELECT vox.*, o.*, z+dz AS tz, y+dy AS ty, x+dx AS tx FROM vox, o) a JOIN vox b ON b.z=tz AND b.y=ty AND b.x=tx AND a.v<>b.v GROUP BY 1,2,3);;
 SELECT v.z,v.y,v.x,m.d2 FROM vox v LEFT JOIN m USING (z,y,x)""")


@C.add("edge", "SELECT * FROM (SELECT p1,p2,w, dense_rank() OVER (PARTITION BY p1//25 ORDER BY p1) AS r FROM edge) WHERE r<=5")
def patch_limit(spark, d):
    """All relations of the first five patches of each block."""
    w = Window.partitionBy(g.div(F.col("p1"), 25)).orderBy("p1")
    return V.edges(spark, d).withColumn("r", F.dense_rank().over(w).cast("long")).where("r <= 5")


@C.add("edge", "SELECT blk, v, n FROM (SELECT p1//25 AS blk, p1 AS v, count(*) AS n, row_number() OVER (PARTITION BY p1//25 ORDER BY count(*) DESC, p1) AS r FROM edge GROUP BY p1) WHERE r=1")
def most_frequent_vertex(spark, d):
    n = V.edges(spark, d).groupBy("p1").agg(F.count("*").alias("n"))
    return n.groupBy(g.div(F.col("p1"), 25).alias("blk")).agg(F.max_by("p1", F.struct("n", -F.col("p1"))).alias("v"), F.max("n").alias("n"))


@C.add("surf", """SELECT a.file AS a, b.file AS b, count(*) AS common FROM surf a JOIN surf b ON a.x=b.x AND a.y=b.y AND a.z=b.z AND a.file<b.file GROUP BY 1,2""")
def set_overlap(spark, d):
    return common_counts(V.point_sets(spark, d), "file", ["x", "y", "z"], "common")


@C.add("surf", "SELECT x,y,z FROM surf WHERE file%2=0 INTERSECT SELECT x,y,z FROM surf WHERE file%2=1")
def set_intersection(spark, d):
    s = V.point_sets(spark, d)
    return s.where("file % 2 = 0").select("x", "y", "z").intersect(s.where("file % 2 = 1").select("x", "y", "z"))


@C.add("surf", "SELECT x,y,z FROM surf WHERE file%2=0 UNION SELECT x,y,z FROM surf WHERE file%3=0")
def set_union(spark, d):
    s = V.point_sets(spark, d)
    return s.where("file % 2 = 0 or file % 3 = 0").select("x", "y", "z").distinct()


@C.add("edge", "SELECT p1 AS id FROM edge WHERE w<=5 EXCEPT SELECT p2 FROM edge WHERE w>9")
def round_difference(spark, d):
    """What one round names and the other does not."""
    e = V.edges(spark, d)
    return e.where("w <= 5").select(F.col("p1").alias("id")).distinct().join(e.where("w > 9").select(F.col("p2").alias("id")), "id", "left_anti")


@C.add("rel", """SELECT p1,p2,round(a,6)+0 AS a,round(b,6)+0 AS b,round(c,6)+0 AS c,round(d,6)+0 AS d,round(e,6)+0 AS e,round(f,6)+0 AS f,v0 FROM rel
 UNION ALL SELECT p2,p1,round(a,6)+0,round(d,6)+0,round(-(a*c+d*f),6)+0,round(b,6)+0,round(e,6)+0,round(-(b*c+e*f),6)+0,v0 FROM rel""")
def symmetric_closure(spark, d):
    """Relations and their inverses, with the same variances."""
    r = V.relations(spark, d)
    m = g.cols("a b c d e f")
    pick = lambda p, q, t: r.select(F.col(p).alias("p1"), F.col(q).alias("p2"), *((R(x) + F.lit(0)).alias(k) for k, x in zip("abcdef", t, strict=True)), "v0")
    return pick("p1", "p2", m).unionAll(pick("p2", "p1", g.rigid_inverse(m)))


@C.add("surf", "SELECT DISTINCT file, x+dx AS x, y+dy AS y, z+dz AS z FROM surf, range(-1,2) a(dx), range(-1,2) b(dy), range(-1,2) c(dz)")
def dilate_set(spark, d):
    return dilated_sets(V.set_points(spark, d), "file")


@C.add("surf", "SELECT DISTINCT file, x, z FROM surf")
def project_set(spark, d):
    return V.point_sets(spark, d).select("file", "x", "z").distinct()


@C.add("vox", """SELECT z,y,x, coalesce(lag(g) OVER w,lead(g) OVER w,g)+2*g+coalesce(lead(g) OVER w,lag(g) OVER w,g) AS s FROM vox WINDOW w AS (PARTITION BY y,x ORDER BY z)""")
def line_smooth(spark, d):
    """[1 2 1] along z, mirrored at the ends."""
    return along(V.voxels(spark, d), "z", "s", "g", {-1: 1, 0: 2, 1: 1}).select("z", "y", "x", "s")


@C.add("sample", """SELECT file, iter, score, sum(score) OVER w AS window_sum, count(*) OVER w AS window_n FROM sample WINDOW w AS (PARTITION BY file ORDER BY iter ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def rolling_scores(spark, d):
    w = Window.partitionBy("file").orderBy("iter").rowsBetween(-9, 0)
    return V.samples(spark, d).select("file", "iter", "score", F.sum("score").over(w).alias("window_sum"), F.count("*").over(w).alias("window_n"))
