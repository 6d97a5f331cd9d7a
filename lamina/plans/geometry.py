"""Scalar geometry and predicates over every relation, mesh point and voxel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)
MAP = "a b c d e f"
PLANE = g.plane_basis((3, 1, 2), (-1, 3, 0))


def lines(names: str, exprs) -> list:
    return [R(e.cast("double")).alias(n) for n, e in zip(names.split(), exprs, strict=True)]


@C.add("rel", """SELECT m.p1, m.p2, n.p2 AS p3, round(m.a*n.a+m.b*n.d,6)+0 AS a, round(m.a*n.b+m.b*n.e,6)+0 AS b, round(m.a*n.c+m.b*n.f+m.c,6)+0 AS c,
 round(m.d*n.a+m.e*n.d,6)+0 AS d, round(m.d*n.b+m.e*n.e,6)+0 AS e, round(m.d*n.c+m.e*n.f+m.f,6)+0 AS f FROM rel m JOIN rel n ON m.p2=n.p1""")
def affine_compose(spark, d):
    r = V.relations(spark, d)
    m, n = r.alias("m"), r.alias("n")
    out = g.compose(g.cols(MAP, "m."), g.cols(MAP, "n."))
    return m.join(n, F.col("m.p2") == F.col("n.p1")).select("m.p1", "m.p2", F.col("n.p2").alias("p3"), *((R(e) + F.lit(0)).alias(k) for k, e in zip(MAP.split(), out, strict=True)))


@C.add("rel", """SELECT p1,p2, round(a,6)+0 AS a, round(d,6)+0 AS b, round(-(a*c+d*f),6)+0 AS c, round(b,6)+0 AS d, round(e,6)+0 AS e, round(-(b*c+e*f),6)+0 AS f,
 round(abs(a*a+b*b-1)+abs(a*d+b*e),6)+0 AS error FROM rel""")
def affine_inverse_roundtrip(spark, d):
    m = g.cols(MAP)
    inv = g.rigid_inverse(m)
    one = g.compose(m, inv)
    return V.relations(spark, d).select("p1", "p2", *((R(e) + F.lit(0)).alias(k) for k, e in zip(MAP.split(), inv, strict=True)), (R(F.abs(one[0] - 1) + F.abs(one[3])) + F.lit(0)).alias("error"))


@C.add("rel", "SELECT p1,p2, round(c,6) AS x, round(f,6) AS y, round(atan2(d,a),6)+0 AS angle FROM rel")
def affine_to_placement(spark, d):
    x, y, t = g.placement(g.cols(MAP))
    return V.relations(spark, d).select("p1", "p2", R(x).alias("x"), R(y).alias("y"), (R(t) + F.lit(0)).alias("angle"))


@C.add("rel", "SELECT p1,p2, round(cos(w/8.0),6)+0 AS a, round(-sin(w/8.0),6)+0 AS b, round(c,6) AS c, round(sin(w/8.0),6)+0 AS d, round(f,6) AS f FROM rel")
def placement_to_affine(spark, d):
    t = g.from_placement(F.col("c"), F.col("f"), F.col("w") / 8.0)
    return V.relations(spark, d).select("p1", "p2", *((R(t[i]) + F.lit(0)).alias(k) for i, k in ((0, "a"), (1, "b"), (2, "c"), (3, "d"), (5, "f"))))


@C.add("pp rel", """SELECT p1,p2,qx,qy, round(a*qx+b*qy+c,4)+0 AS x, round(d*qx+e*qy+f,4)+0 AS y FROM rel JOIN pp ON pid=p1""")
def affine_apply(spark, d):
    j = V.relations(spark, d).join(V.patch_points(spark, d), F.col("pid") == F.col("p1"))
    x, y = g.apply(g.cols(MAP), F.col("qx"), F.col("qy"))
    return j.select("p1", "p2", "qx", "qy", (R(x, 4) + F.lit(0)).alias("x"), (R(y, 4) + F.lit(0)).alias("y"))


@C.add("rel", """SELECT m.p1,m.p2,n.p2 AS p3, round(CASE WHEN s>pi() THEN s-2*pi() WHEN s<=-pi() THEN s+2*pi() ELSE s END,6)+0 AS angle
 FROM (SELECT m.p1,m.p2,n.p2 AS q, m.w/4.0*0.9+n.w/4.0*0.8 AS s FROM rel m JOIN rel n ON m.p2=n.p1) z JOIN rel m ON m.p1=z.p1 AND m.p2=z.p2 JOIN rel n ON n.p1=z.p2 AND n.p2=z.q""")
def angle_wrap(spark, d):
    r = V.relations(spark, d)
    m, n = r.alias("m"), r.alias("n")
    s = g.add_angle(F.col("m.w") / 4.0 * 0.9, F.col("n.w") / 4.0 * 0.8)
    return m.join(n, F.col("m.p2") == F.col("n.p1")).select("m.p1", "m.p2", F.col("n.p2").alias("p3"), (R(s) + F.lit(0)).alias("angle"))


@C.add("pp", """SELECT pid,qx,qy, vx*1+vy*2+vz*3 AS dot, vy*3-vz*2 AS cx, vz*1-vx*3 AS cy, vx*2-vy*1 AS cz, round(sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE),6) AS len,
 round(vz/nullif(sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE),0),6)+0 AS nz, round(sqrt(((vx-4)*(vx-4)+vy*vy+vz*vz)::DOUBLE),6) AS dist FROM pp""")
def vector_products(spark, d):
    p = g.cols("vx vy vz")
    q = [F.lit(1), F.lit(2), F.lit(3)]
    cx, cy, cz = g.cross(p, q)
    return V.patch_points(spark, d).select(
        "pid", "qx", "qy", g.dot(p, q).alias("dot"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"), R(g.length(p)).alias("len"), (R(g.normalised(p)[2]) + F.lit(0)).alias("nz"),
        R(g.distance([F.lit(4), F.lit(0), F.lit(0)], p)).alias("dist"),
    )


@C.add("pp", """SELECT pid,qx,qy, round(acos(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,vz/nullif(sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE),0)))),6)+0 AS tilt FROM pp""")
def vector_angle(spark, d):
    return V.patch_points(spark, d).select("pid", "qx", "qy", (R(g.angle_between(g.cols("vx vy vz"), [F.lit(0), F.lit(0), F.lit(1)])) + F.lit(0)).alias("tilt"))


@C.add("pg", "SELECT pid, qx, qy, gx, gy FROM pg")
def local_to_global(spark, d):
    return V.placed_points(spark, d).select("pid", "qx", "qy", "gx", "gy")


@C.add("pp", "SELECT pid, -qx AS qx, qy, vx, vy, vz FROM pp")
def patch_flip(spark, d):
    return V.patch_points(spark, d).withColumn("qx", -F.col("qx"))


@C.add("pp", "SELECT vx//64 AS cx, vy//64 AS cy, vz//64 AS cz, CAST(floor(qx/12.0) AS BIGINT) AS mx, qx//12 AS tx, count(*) AS n FROM pp GROUP BY ALL")
def cell_key(spark, d):
    v = lambda c: g.div(F.col(c), 64)
    return V.patch_points(spark, d).groupBy(v("vx").alias("cx"), v("vy").alias("cy"), v("vz").alias("cz"), g.cell(F.col("qx"), 12).alias("mx"), g.div(F.col("qx"), 12).alias("tx")).agg(F.count("*").alias("n"))


@C.add("pp", "SELECT pid,qx,qy, " + ", ".join(f"(vx*({v[0]})+vy*({v[1]})+vz*({v[2]}))//1000 AS p{i}" for i, v in enumerate(PLANE)) + " FROM pp")
def project_plane(spark, d):
    return V.patch_points(spark, d).select("pid", "qx", "qy", *(c.alias(f"p{i}") for i, c in enumerate(g.project(g.cols("vx vy vz"), PLANE))))


@C.add("surf", "SELECT file,x,y,z, ((y+1)*1024+x+1)*1024+z+1 AS key, x AS ux, y AS uy, z AS uz FROM surf")
def pack_unpack(spark, d):
    s = V.point_sets(spark, d).withColumn("key", g.pack(*g.cols("x y z")))
    ux, uy, uz = g.unpack(F.col("key"))
    return s.select("file", "x", "y", "z", "key", ux.alias("ux"), uy.alias("uy"), uz.alias("uz"))


COLOUR = "255-80*({0}%3)-({0}//105)%79 AS r, 255-40*((3*{0})%5)-({0}//105)%37 AS g, 255-26*((5*{0})%7)-({0}//105)%23 AS b"


@C.add("pp", "SELECT pid, count(*) AS n, " + COLOUR.format("pid") + " FROM pp GROUP BY pid")
def colour_hash(spark, d):
    r, gr, b = g.patch_colour(F.col("pid"))
    return V.patch_points(spark, d).groupBy("pid").agg(F.count("*").alias("n")).select("pid", "n", r.alias("r"), gr.alias("g"), b.alias("b"))


@C.add("pp", f"""k AS (SELECT c, {COLOUR.format('c')} FROM range(100000) t(c)), i AS (SELECT r,g,b, max(c) AS last, count(*) AS n FROM k GROUP BY 1,2,3),
 p AS (SELECT pid, {COLOUR.format('pid')} FROM (SELECT DISTINCT pid FROM pp));; SELECT pid, last, n FROM p JOIN i USING (r,g,b)""")
def colour_inverse(spark, d):
    """The patch numbers below 100000 that have a patch's colour: the last of them and how many."""
    named = lambda c: [x.alias(n) for n, x in zip("rgb", g.patch_colour(F.col(c)), strict=True)]
    table = spark.range(100_000).select("id", *named("id")).groupBy("r", "g", "b").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    return V.patch_points(spark, d).select("pid").distinct().select("pid", *named("pid")).join(table, ["r", "g", "b"]).select("pid", "last", "n")


@C.add("pg", """SELECT pid,qx,qy, 96+(CASE WHEN n%2000>=1000 THEN 2000-n%2000 ELSE n%2000 END)*159//1000 AS r,
 96+(CASE WHEN (n+1250)%2500>=1250 THEN 2500-(n+1250)%2500 ELSE (n+1250)%2500 END)*159//1250 AS g,
 96+(CASE WHEN (n+1500)%3000>=1500 THEN 3000-(n+1500)%3000 ELSE (n+1500)%3000 END)*159//1500 AS b FROM (SELECT *, (gx+20)*20+gy+20 AS n FROM pg)""")
def coordinate_colour(spark, d):
    r, gr, b = g.coordinate_colour((F.col("gx") + 20) * 20 + F.col("gy") + 20)
    return V.placed_points(spark, d).select("pid", "qx", "qy", r.alias("r"), gr.alias("g"), b.alias("b"))


@C.add("vox", "SELECT z,y,x, least(greatest((3*g-100)//2,0),255) AS v FROM vox")
def grey_transfer(spark, d):
    return V.voxels(spark, d).select("z", "y", "x", g.grey(F.col("g"), 3, -100, 2).alias("v"))


@C.add("pp", """SELECT pid,qx,qy, round((20*(qx+20)-0*(qy+20))/800.0+0,6) AS u, round((20*(qx+20)*0+40*(qy+20))/1600.0+0,6) AS v,
 (qx+20)/40.0+(qy+20)/40.0<=1 AND qx>=-20 AND qy>=-20 AS inside FROM pp""")
def barycentric_weights(spark, d):
    """Weights of the corners (20,-20) and (-20,20) of a right triangle over each patch's mesh."""
    corner = lambda x, y: [F.lit(float(x)), F.lit(float(y))]
    u, v, w = g.barycentric(g.cols("qx qy"), corner(20, -20), corner(-20, 20), corner(-20, -20))
    return V.patch_points(spark, d).select("pid", "qx", "qy", R(u).alias("u"), R(v).alias("v"), ((R(u) + R(v) <= 1) & (u >= 0) & (v >= 0)).alias("inside"))


C.sql["barycentric_weights"] = V.oracle("pp", """SELECT pid,qx,qy, round((qx+20)/40.0::DOUBLE,6) AS u, round((qy+20)/40.0::DOUBLE,6) AS v,
 round((qx+20)/40.0::DOUBLE,6)+round((qy+20)/40.0::DOUBLE,6)<=1 AND qx>=-20 AND qy>=-20 AS inside FROM pp""")


@C.add("pp", "SELECT pid, qx-min(qx) OVER (PARTITION BY pid) AS x, qy-min(qy) OVER (PARTITION BY pid) AS y, vx, vy, vz FROM pp")
def normalise_patch(spark, d):
    w = Window.partitionBy("pid")
    return V.patch_points(spark, d).select("pid", (F.col("qx") - F.min("qx").over(w)).alias("x"), (F.col("qy") - F.min("qy").over(w)).alias("y"), "vx", "vy", "vz")


@C.add("pp", """SELECT pid,qx,qy, round(CASE WHEN r/12.0>=2 THEN 0 ELSE 0.25*r/12*r/12-r/12+1 END,6)+0 AS k, round(CASE WHEN r/12.0>=2 OR r=0 THEN 0 ELSE (0.5*r/12-1)/(12*r) END,6)+0 AS slope
 FROM (SELECT *, sqrt((qx*qx+qy*qy)::DOUBLE) AS r FROM pp)""")
def sph_kernel(spark, d):
    r = g.length(g.cols("qx qy"))
    return V.patch_points(spark, d).select("pid", "qx", "qy", (R(g.kernel(r, 12.0)) + F.lit(0)).alias("k"), (R(g.kernel_slope(r, 12.0)) + F.lit(0)).alias("slope"))


@C.add("sample", """SELECT file,iter, CASE WHEN t-trunc(t)<0.5 THEN CAST(trunc(t) AS BIGINT) ELSE CAST(trunc(t) AS BIGINT)+1 END AS r FROM (SELECT *, score/100.0::DOUBLE-40 AS t FROM sample)""")
def round_half_up(spark, d):
    return V.samples(spark, d).select("file", "iter", g.half_up(F.col("score") / 100.0 - 40).alias("r"))


@C.add("rel", "SELECT p1,p2,w FROM rel WHERE v0<=0.006 AND v2<=2.5")
def variance_filter(spark, d):
    return V.relations(spark, d).where("v0 <= 0.006 and v2 <= 2.5").select("p1", "p2", "w")


@C.add("pp", "SELECT pid,qx,qy,vx,vy,vz FROM pp WHERE vx BETWEEN 8 AND 400 AND vy BETWEEN 8 AND 200 AND vz BETWEEN 20 AND 36")
def crop_box(spark, d):
    return V.patch_points(spark, d).where(F.col("vx").between(8, 400) & F.col("vy").between(8, 200) & F.col("vz").between(20, 36))


@C.add("pp", """SELECT pp.* FROM pp JOIN (SELECT pid FROM pp GROUP BY pid HAVING min(vz)<=36 AND max(vz)>=36) USING (pid) WHERE vz=36""")
def z_slice(spark, d):
    """Points of one slice: patches by their extent first, then the points."""
    pp = V.patch_points(spark, d)
    cross = pp.groupBy("pid").agg(F.min("vz").alias("lo"), F.max("vz").alias("hi")).where("lo <= 36 and hi >= 36").select("pid")
    return pp.where("vz = 36").join(cross, "pid", "left_semi")


@C.add("pp", "SELECT pid,qx,qy FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY qx,qy) AS n FROM pp) WHERE n%10=0")
def decimate(spark, d):
    w = Window.partitionBy("pid").orderBy("qx", "qy")
    return V.patch_points(spark, d).withColumn("n", F.row_number().over(w)).where("n % 10 = 0").select("pid", "qx", "qy")


@C.add("surf", "SELECT * FROM surf WHERE x IN (0,63) OR y IN (0,7) OR z IN (0,63)")
def cube_edge_points(spark, d):
    return V.point_sets(spark, d).where("x in (0, 63) or y in (0, 7) or z in (0, 63)")


@C.add("vox", "SELECT z, y, x, v FROM vox WHERE z%3=0 AND x BETWEEN 2 AND 5 AND v=255")
def volume_crop(spark, d):
    return V.voxels(spark, d).where("z % 3 = 0 and x between 2 and 5 and v = 255").select("z", "y", "x", "v")
