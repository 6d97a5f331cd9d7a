"""Distance, overlap and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import spatial as S
from lamina.operators.near import nearest_of_others
from lamina.operators.sets import common_counts, met_counts
from lamina.operators.voxel import AXES, FACES
from lamina.plans.catalog import Catalog
from lamina.sources import views as V
from lamina.sources.scratch import saved

C = Catalog()
R = lambda c, n=6: F.round(c, n)
COORDS = "vx vy vz"
D3 = "sqrt((({0}.vx-{1}.vx)*({0}.vx-{1}.vx)+({0}.vy-{1}.vy)*({0}.vy-{1}.vy)+({0}.vz-{1}.vz)*({0}.vz-{1}.vz))::DOUBLE)"
#: DuckDB: an equi-join on cells, as the plain form is quadratic.
NEAR = """l AS (SELECT *, CAST(floor(vx/{s}.0) AS BIGINT) AS i, CAST(floor(vy/{s}.0) AS BIGINT) AS j, CAST(floor(vz/{s}.0) AS BIGINT) AS k FROM {left}),
 r AS (SELECT t.*, CAST(floor(vx/{s}.0) AS BIGINT)+a AS i, CAST(floor(vy/{s}.0) AS BIGINT)+b AS j, CAST(floor(vz/{s}.0) AS BIGINT)+c AS k FROM {right} t, range(-1,2) x(a), range(-1,2) y(b), range(-1,2) w(c))"""


@C.add("pp", NEAR.format(s=6, left="pp", right="pp") + f""";; SELECT l.pid AS a, r.pid AS b, count(*) AS pairs, round(min({D3.format('l', 'r')}),6) AS nearest
 FROM l JOIN r USING (i,j,k) WHERE l.pid<r.pid AND {D3.format('l', 'r')}<6 GROUP BY 1,2""")
def cell_join_pairs(spark, d):
    """Close points of different patches, by pair of patches."""
    p = V.patch_points(spark, d).select("pid", *COORDS.split())
    return S.close_pairs(p, "pid", COORDS, 6).groupBy("a", "b").agg(F.count("*").alias("pairs"), R(F.min("dist")).alias("nearest"))


@C.add("pp", NEAR.format(s=8, left="pp", right="pp") + f""", n AS (SELECT l.pid, l.qx, l.qy, r.pid AS npid, r.qx AS nqx, r.qy AS nqy, {D3.format('l', 'r')} AS dist FROM l JOIN r USING (i,j,k) WHERE l.pid<>r.pid AND {D3.format('l', 'r')}<8),
 k AS (SELECT *, row_number() OVER (PARTITION BY pid,qx,qy ORDER BY dist,npid,nqx,nqy) AS rank FROM n);; SELECT pid,qx,qy,npid,nqx,nqy,rank,round(dist,6) AS dist FROM k WHERE rank<=3""")
def nearest_three(spark, d):
    """The three nearest points of other patches; ties by patch and mesh position."""
    k = nearest_of_others(V.patch_points(spark, d), "pid", ["qx", "qy"], COORDS, 8, 3)
    return k.select(F.col("l_pid").alias("pid"), F.col("l_qx").alias("qx"), F.col("l_qy").alias("qy"), F.col("r_pid").alias("npid"), F.col("r_qx").alias("nqx"), F.col("r_qy").alias("nqy"), F.col("rank").cast("long").alias("rank"), R("dist").alias("dist"))


@C.add("pp", NEAR.format(s=5, left="pp", right="pp") + f""";; SELECT pid,qx,qy,vx,vy,vz FROM pp WHERE (pid,qx,qy) NOT IN
 (SELECT l.pid,l.qx,l.qy FROM l JOIN r USING (i,j,k) WHERE r.pid<l.pid AND {D3.format('l', 'r')}<5)""")
def erase_by_radius(spark, d):
    """The points that are not within 5 of a point of an earlier patch."""
    pp = V.patch_points(spark, d)
    others = pp.select("pid", *COORDS.split())
    return S.erase_near(pp, others, COORDS, 5, F.col("o_pid") < F.col("pid")).select("pid", "qx", "qy", "vx", "vy", "vz")


@C.add("pp", f"""SELECT p.pid,p.qx,p.qy,c.pid AS centre, round({D3.format('p', 'c')},6) AS dist FROM pp p JOIN (SELECT * FROM pp WHERE qx=0 AND qy=0) c ON c.pid=p.pid+1 WHERE {D3.format('p', 'c')}<30""")
def near_next_centre(spark, d):
    """Points of a patch that lie near the centre of the next one."""
    pp = V.patch_points(spark, d)
    c = pp.where("qx = 0 and qy = 0").select((F.col("pid") - 1).alias("pid"), *(F.col(f"v{a}").alias(f"c{a}") for a in "xyz"))
    return pp.join(c, "pid").withColumn("dist", R(g.distance(g.cols(COORDS), g.cols("cx cy cz")))).where("dist < 30").select("pid", "qx", "qy", (F.col("pid") + 1).alias("centre"), "dist")


@C.add("pp", "SELECT a.pid,a.qx,a.qy,count(*) AS neighbours FROM pp a JOIN pp b ON a.pid=b.pid AND abs(a.qx-b.qx)+abs(a.qy-b.qy)=1 GROUP BY 1,2,3")
def mesh_neighbours(spark, d):
    """Mesh points with their number of direct neighbours: each point sends itself to the four around it."""
    o = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    pp = V.patch_points(spark, d).select("pid", "qx", "qy")
    sent = pp.withColumn("o", F.explode(o)).groupBy("pid", (F.col("qx") + F.col("o.i")).alias("qx"), (F.col("qy") + F.col("o.j")).alias("qy")).agg(F.count("*").alias("neighbours"))
    return pp.join(sent, ["pid", "qx", "qy"])


@C.add("pg", """f AS (SELECT gx//4 AS cx, gy//4 AS cy, min(pid) AS first FROM pg GROUP BY 1,2), p AS (SELECT DISTINCT gx//4 AS cx, gy//4 AS cy, pid, max(vz) OVER (PARTITION BY gx//4,gy//4,pid) AS z FROM pg);;
 SELECT DISTINCT a.pid AS a, b.pid AS b FROM f JOIN p a ON a.cx=f.cx AND a.cy=f.cy AND a.pid=f.first JOIN p b ON b.cx=f.cx AND b.cy=f.cy AND b.pid>a.pid WHERE abs(a.z-b.z)>10""")
def raster_collision(spark, d):
    """Pairs of the first patch of a raster cell and later ones that stand more than 10 away, each once."""
    cell = lambda c: g.div(F.col(c), 4)
    p = V.placed_points(spark, d).groupBy(cell("gx").alias("cx"), cell("gy").alias("cy"), "pid").agg(F.max("vz").alias("z"))
    f = p.groupBy("cx", "cy").agg(F.min("pid").alias("a"), F.min_by("z", "pid").alias("za"))
    return p.join(f, ["cx", "cy"]).where("pid > a and abs(z - za) > 10").select("a", F.col("pid").alias("b")).distinct()


@C.add("pg", "SELECT DISTINCT gx//16+i AS tx, gy//16+j AS ty, pid FROM pg, range(-1,2) a(i), range(-1,2) b(j)")
def tile_index(spark, d):
    tile = lambda c: g.div(F.col(c), 16)
    t = V.placed_points(spark, d).select(tile("gx").alias("c0"), tile("gy").alias("c1"), "pid").distinct()
    return S.around(t, 2).select(F.col("c0").alias("tx"), F.col("c1").alias("ty"), "pid").distinct()


@C.add("pp", """q AS (SELECT pid, qx, qy, qx+((qx+20)%4)/4.0::DOUBLE AS x, qy+((qy+20)%4)/4.0::DOUBLE AS y FROM pp);;
 SELECT q.pid,q.qx,q.qy, round(a.vz*(1-(x-q.qx))*(1-(y-q.qy))+b.vz*(x-q.qx)*(1-(y-q.qy))+c.vz*(1-(x-q.qx))*(y-q.qy)+e.vz*(x-q.qx)*(y-q.qy),6) AS z
 FROM q JOIN pp a ON a.pid=q.pid AND a.qx=q.qx AND a.qy=q.qy JOIN pp b ON b.pid=q.pid AND b.qx=q.qx+1 AND b.qy=q.qy JOIN pp c ON c.pid=q.pid AND c.qx=q.qx AND c.qy=q.qy+1 JOIN pp e ON e.pid=q.pid AND e.qx=q.qx+1 AND e.qy=q.qy+1""")
def quad_lookup(spark, d):
    """Bilinear height at a point inside each mesh quad that has all four corners."""
    pp = V.patch_points(spark, d)
    u, v = ((F.col(c) + 20) % 4 / 4.0 for c in ("qx", "qy"))
    h = quads(pp, ["vz"])
    z = F.col("vz00") * (1 - u) * (1 - v) + F.col("vz10") * u * (1 - v) + F.col("vz01") * (1 - u) * v + F.col("vz11") * u * v
    return h.select("pid", "qx", "qy", R(z).alias("z"))


def quads(points, values: list[str]):
    """(pid, qx, qy, <value>00, 10, 01, 11): quads with all four corners, by their low corner. Every point goes to its four quads."""
    o = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (0, 1) for j in (0, 1)))
    sent = points.withColumn("o", F.explode(o)).select("pid", (F.col("qx") - F.col("o.i")).alias("qx"), (F.col("qy") - F.col("o.j")).alias("qy"), "o", *values)
    pick = [F.max(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col(v))).alias(f"{v}{i}{j}") for v in values for i in (0, 1) for j in (0, 1)]
    return sent.groupBy("pid", "qx", "qy").agg(F.count("*").alias("n"), *pick).where("n = 4").drop("n")


@C.add("surf", """b AS (SELECT file, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM surf GROUP BY file);; SELECT l.file AS a, r.file AS b FROM b l JOIN b r ON l.file<r.file AND l.x0<=r.x1 AND r.x0<=l.x1 AND l.z0<=r.z1 AND r.z0<=l.z1""")
def bbox_overlap(spark, d):
    b = V.point_sets(spark, d).groupBy("file").agg(*(f(a).alias(f"{a}{k}") for a in "xz" for f, k in ((F.min, "min"), (F.max, "max"))))
    return S.box_overlap(b, "file", "x z")


BOUNDARY = """n AS (SELECT file, count(*) AS n FROM surf GROUP BY file), c AS (SELECT a.file AS a, b.file AS b, count(*) AS common FROM surf a JOIN surf b USING (x,y,z) WHERE a.file<b.file GROUP BY 1,2),
 q AS (SELECT DISTINCT file,x,z FROM surf), p AS (SELECT a.file AS a, b.file AS b, count(*) AS flat FROM q a JOIN q b USING (x,z) WHERE a.file<b.file GROUP BY 1,2)"""


@C.add("surf", BOUNDARY + """;; SELECT a, b, common, flat, common>sqrt(least(l.n,r.n)::DOUBLE)/4 AND flat<=20*common AS fits FROM c JOIN p USING (a,b) JOIN n l ON l.file=a JOIN n r ON r.file=b""")
def shared_boundary(spark, d):
    """Pairs of sets by common points and common projections, and whether they fit as neighbours."""
    s = saved(V.point_sets(spark, d))
    n = s.groupBy("file").agg(F.count("*").alias("n"))
    j = common_counts(s, "file", ["x", "y", "z"], "common").join(common_counts(s, "file", ["x", "z"], "flat"), ["a", "b"])
    j = j.join(n.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "common", "flat", ((F.col("common") > F.sqrt(F.least("na", "nb").cast("double")) / 4) & (F.col("flat") <= 20 * F.col("common"))).alias("fits"))


@C.add("surf", "SELECT file, x, y, z FROM surf WHERE (x,y,z) IN (SELECT x,y,z FROM surf GROUP BY 1,2,3 HAVING count(*)>1)")
def plug_points(spark, d):
    """Points that another set has too."""
    s = V.point_sets(spark, d)
    shared = s.groupBy("x", "y", "z").agg(F.count("*").alias("n")).where("n > 1").select("x", "y", "z")
    return s.join(shared, ["x", "y", "z"], "left_semi").select("file", "x", "y", "z")


@C.add("surf", """d AS (SELECT DISTINCT file, x+dx AS x, y+dy AS y, z+dz AS z FROM surf, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx,dy,dz) WHERE file%2=0);;
 SELECT d.file AS a, s.file AS b, count(*) AS touching FROM d JOIN surf s USING (x,y,z) WHERE s.file%2=1 GROUP BY 1,2""")
def abutting_sets(spark, d):
    """Sets of two volumes that touch when one is grown by its face neighbours."""
    s = saved(V.point_sets(spark, d))
    even, odd = (s.where(F.col("file") % 2 == k).withColumnRenamed("file", side) for k, side in enumerate("ab"))
    return met_counts(even, odd, ["x", "y", "z"], "touching", grown=[(0, 0, 0), *FACES])


@C.add("surf", """e AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM surf WHERE x IN (0,63));; SELECT a.file AS a, b.file AS b, count(*) AS match FROM e a JOIN e b ON a.y=b.y AND a.z=b.z AND a.x=63 AND b.x=0 AND a.file<>b.file GROUP BY 1,2,a.n,b.n HAVING least(a.n,b.n)<20*count(*)""")
def cube_edge_match(spark, d):
    """Sets whose points on one face of the cube continue on the opposite face of the next."""
    e = saved(V.point_sets(spark, d).where("x in (0, 63)"))
    n = saved(e.groupBy("file").agg(F.count("*").alias("n")))
    keys = tuple(n.select(F.col("file").alias(side), F.col("n").alias(f"n{side}")) for side in "ab")
    a, b = (e.where(F.col("x") == x).select(F.col("file").alias(side), "y", "z") for side, x in (("a", 63), ("b", 0)))
    return met_counts(a, b, ["y", "z"], "match", keys=keys).where("a <> b and least(na, nb) < 20 * match").select("a", "b", "match")


@C.add("surf vox", "SELECT DISTINCT file FROM surf WHERE (x,y,z%8) IN (SELECT z,y,x FROM vox WHERE v=255)")
def fibre_surface(spark, d):
    """Sets that meet the volume's surface anywhere."""
    hit = V.voxels(spark, d).where("v = 255").select(F.col("z").alias("x"), "y", F.col("x").alias("k"))
    return V.point_sets(spark, d).withColumn("k", F.col("z") % 8).join(hit, ["x", "y", "k"], "left_semi").select("file").distinct()


@C.add("pp vox", "SELECT pid,qx,qy,coalesce(g,0) AS grey FROM pp LEFT JOIN vox ON z=vx AND y=vy%8 AND x=vz%8")
def point_voxel_lookup(spark, d):
    """The voxel under each mesh point; none counts as zero."""
    v = V.voxels(spark, d).select("z", "y", "x", "g")
    p = V.patch_points(spark, d).withColumns({"z": F.col("vx"), "y": F.col("vy") % 8, "x": F.col("vz") % 8})
    return p.join(v, list(AXES), "left").select("pid", "qx", "qy", F.coalesce("g", F.lit(0)).alias("grey"))


@C.add("pp", NEAR.format(s=3, left="pp", right="pp") + f""", w AS (SELECT l.pid,l.qx,l.qy,r.vz, CAST(floor(exp(-pow({D3.format('l', 'r')},2))*1000000) AS BIGINT) AS k FROM l JOIN r USING (i,j,k) WHERE l.pid<>r.pid AND {D3.format('l', 'r')}<3);;
 SELECT pid,qx,qy,round(CAST(sum(vz*k) AS DOUBLE)/CAST(sum(k) AS DOUBLE),6) AS z, count(*) AS n FROM w WHERE k>0 GROUP BY 1,2,3""")
def resample_weighted(spark, d):
    """Heights of other patches at each point, weighted by exp(-distance^2) in micro-units."""
    pp = V.patch_points(spark, d)
    near = S.cell_join(pp, pp, COORDS, 3).where("l_pid <> r_pid")
    near = near.withColumn("k", F.floor(F.exp(-F.pow("dist", F.lit(2))) * 1_000_000).cast("long")).where("k > 0")
    z = F.sum(F.col("r_vz") * F.col("k")).cast("double") / F.sum("k").cast("double")
    return near.groupBy(F.col("l_pid").alias("pid"), F.col("l_qx").alias("qx"), F.col("l_qy").alias("qy")).agg(R(z).alias("z"), F.count("*").alias("n"))


@C.add("vox", """s AS (SELECT z,y,x,1 AS f FROM vox WHERE v=255 UNION ALL SELECT z-1,y,x,2 FROM vox WHERE v=255);; SELECT z,y,x FROM s GROUP BY z,y,x HAVING bit_or(f)=3""")
def voxel_and(spark, d):
    """Voxels set both here and one slice on: each sends itself to its own place and to the one before, and both must arrive."""
    on = V.voxels(spark, d).where("v = 255").select(*AXES)
    sent = on.withColumn("f", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("z", F.when(F.col("f") == 1, F.col("z")).otherwise(F.col("z") - 1))
    return sent.groupBy(*AXES).agg(F.bit_or("f").alias("f")).where("f = 3").select(*AXES)


@C.add("pp", """SELECT a.pid, a.qx, a.qy, b.qx AS nx, b.qy AS ny, round(sqrt(((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)+(a.vz-b.vz)*(a.vz-b.vz))::DOUBLE),6) AS rest
 FROM pp a JOIN pp b ON a.pid=b.pid AND b.qx-a.qx BETWEEN -1 AND 1 AND b.qy-a.qy BETWEEN -1 AND 1 AND (a.qx,a.qy)<(b.qx,b.qy)""")
def spring_pairs(spark, d):
    """Springs of the mesh: each pair of the eight-neighbourhood once, with its rest length."""
    o = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    p = V.patch_points(spark, d)
    a = p.withColumn("o", F.explode(o)).withColumns({"nx": F.col("qx") + F.col("o.i"), "ny": F.col("qy") + F.col("o.j")}).drop("o")
    b = p.select("pid", F.col("qx").alias("nx"), F.col("qy").alias("ny"), *(F.col(f"v{k}").alias(f"b{k}") for k in "xyz"))
    return a.join(b, ["pid", "nx", "ny"]).select("pid", "qx", "qy", "nx", "ny", R(g.distance(g.cols(COORDS), g.cols("bx by bz"))).alias("rest"))


@C.add("pp", NEAR.format(s=2, left="pp", right="pp") + f""";; SELECT pid,qx,qy FROM pp WHERE (pid,qx,qy) IN (SELECT l.pid,l.qx,l.qy FROM l JOIN r USING (i,j,k) WHERE (l.pid,l.qx,l.qy)<>(r.pid,r.qx,r.qy) AND {D3.format('l', 'r')}<2)""")
def close_neighbour(spark, d):
    """Points that already have another within 2."""
    near = S.cell_join(V.patch_points(spark, d), V.patch_points(spark, d), COORDS, 2).where("l_pid <> r_pid or l_qx <> r_qx or l_qy <> r_qy")
    return near.select(F.col("l_pid").alias("pid"), F.col("l_qx").alias("qx"), F.col("l_qy").alias("qy")).distinct()


@C.add("pg", """SELECT gx, gy, max(abs(a.vz-b.vz)) AS worst, count(*) AS pairs FROM pg a JOIN pg b USING (gx,gy) WHERE a.pid<b.pid AND a.pid%7<>3 AND b.pid%7<>3 GROUP BY 1,2""")
def cell_contributions(spark, d):
    """The largest height difference among good patches of each cell: max minus min, without forming pairs."""
    c = V.placed_points(spark, d).where("pid % 7 <> 3").groupBy("gx", "gy").agg(F.count("*").alias("n"), (F.max("vz") - F.min("vz")).alias("worst")).where("n > 1")
    return c.select("gx", "gy", "worst", g.div(F.col("n") * (F.col("n") - 1), 2).alias("pairs"))
