"""Extents, scores and statistics per patch, set, raster cell and log file."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators.ranges import running_sum
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)


@C.add("pp", """SELECT pid, min(qx) AS qx_min, max(qx) AS qx_max, min(qy) AS qy_min, max(qy) AS qy_max, min(vx) AS x_min, max(vx) AS x_max, min(vy) AS y_min, max(vy) AS y_max,
 min(vz) AS z_min, max(vz) AS z_max, greatest(abs(min(qx)),abs(max(qx)),abs(min(qy)),abs(max(qy))) AS radius, count(*) AS n FROM pp GROUP BY pid""")
def patch_extents(spark, d):
    ends = [f(c).alias(f"{n}_{k}") for c, n in (("qx", "qx"), ("qy", "qy"), ("vx", "x"), ("vy", "y"), ("vz", "z")) for f, k in ((F.min, "min"), (F.max, "max"))]
    radius = F.greatest(*(F.abs(f(c)) for c in ("qx", "qy") for f in (F.min, F.max)))
    return V.patch_points(spark, d).groupBy("pid").agg(*ends, radius.alias("radius"), F.count("*").alias("n"))


@C.add("pp", "SELECT pid, vx, vy, vz FROM pp WHERE qx=0 AND qy=0")
def patch_centre(spark, d):
    return V.patch_points(spark, d).where("qx = 0 and qy = 0").select("pid", "vx", "vy", "vz")


@C.add("pp", "SELECT pid, round(avg(vx),6) AS x, round(avg(vy),6) AS y, round(avg(vz),6) AS z, round(sqrt(avg((vz-20)*(vz-20))),6) AS rms FROM pp GROUP BY pid")
def centroid_and_fit(spark, d):
    return V.patch_points(spark, d).groupBy("pid").agg(*(R(F.avg(f"v{a}")).alias(a) for a in "xyz"), R(F.sqrt(F.avg((F.col("vz") - 20) ** 2))).alias("rms"))


@C.add("rel", """s AS (SELECT p1, avg(a) AS ma, var_pop(a) AS va, avg(c) AS mc, var_pop(c) AS vc, avg(f) AS mf, var_pop(f) AS vf, count(*) AS n FROM rel GROUP BY p1),
 k AS (SELECT p1, p2 AS rep FROM (SELECT rel.p1, rel.p2, row_number() OVER (PARTITION BY rel.p1 ORDER BY round((c-mc)*(c-mc)+(f-mf)*(f-mf),6), p2) AS r FROM rel JOIN s ON rel.p1=s.p1) WHERE r=1);;
 SELECT p1, round(ma,6)+0 AS ma, round(va,6)+0 AS va, round(mc,6)+0 AS mc, round(vc,6)+0 AS vc, round(mf,6)+0 AS mf, round(vf,6)+0 AS vf, n, rep FROM s JOIN k USING (p1)""")
def affine_mean_variance(spark, d):
    """Mean and population variance of the samples of each patch, and the sample nearest to the mean."""
    r = V.relations(spark, d)
    s = r.groupBy("p1").agg(*(f(c).alias(f"{k}{c}") for c in "acf" for f, k in ((F.avg, "m"), (F.var_pop, "v"))), F.count("*").alias("n"))
    far = R((F.col("c") - F.col("mc")) ** 2 + (F.col("f") - F.col("mf")) ** 2)
    rep = r.join(s, "p1").groupBy("p1").agg(F.min_by("p2", F.struct(far, "p2")).alias("rep"))
    return s.join(rep, "p1").select("p1", *((R(F.col(f"{k}{c}")) + F.lit(0)).alias(f"{k}{c}") for c in "acf" for k in "mv"), "n", "rep")


@C.add("pg", """SELECT l.pid AS a, r.pid AS b, count(*) AS cells, round(max(sqrt(((l.vx-r.vx)*(l.vx-r.vx)+(l.vy-r.vy)*(l.vy-r.vy)+(l.vz-r.vz)*(l.vz-r.vz))::DOUBLE)),6) AS worst
 FROM pg l JOIN pg r ON l.gx=r.gx AND l.gy=r.gy AND l.pid<r.pid GROUP BY 1,2""")
def overlap_mismatch(spark, d):
    """Flagship: which placed patches overlap on the mesh, and how far apart their surfaces are there."""
    return pair_scores(V.placed_points(spark, d))


def pair_scores(points):
    l, r = points.alias("l"), points.alias("r")
    dist = g.distance(g.cols("vx vy vz", "l."), g.cols("vx vy vz", "r."))
    same = (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")) & (F.col("l.pid") < F.col("r.pid"))
    return l.join(r, same).groupBy(F.col("l.pid").alias("a"), F.col("r.pid").alias("b")).agg(F.count("*").alias("cells"), R(F.max(dist)).alias("worst"))


@C.add("pg", "SELECT gx//32 AS tx, gy//32 AS ty, count(DISTINCT (gx,gy)) AS cells, count(*) AS points FROM pg GROUP BY 1,2")
def coverage_cells(spark, d):
    tile = lambda c: g.div(F.col(c), 32)
    cells = V.placed_points(spark, d).groupBy("gx", "gy").agg(F.count("*").alias("n"))
    return cells.groupBy(tile("gx").alias("tx"), tile("gy").alias("ty")).agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


@C.add("pg", """c AS (SELECT gx//5 AS cx, gy//5 AS cy, count(*) AS n, max(vz)-min(vz) AS spread FROM pg GROUP BY 1,2);;
 SELECT cx//8 AS tx, cy//8 AS ty, count(*) AS area, CAST(sum(spread//3) AS BIGINT) AS inconsistency, CAST(sum(n-1) AS BIGINT) AS again FROM c GROUP BY 1,2""")
def area_and_inconsistency(spark, d):
    """Per tile: occupied cells of 5, the spread of heights inside them, and repeated placements."""
    cell = lambda c: g.div(F.col(c), 5)
    cells = V.placed_points(spark, d).groupBy(cell("gx").alias("cx"), cell("gy").alias("cy")).agg(F.count("*").alias("n"), (F.max("vz") - F.min("vz")).alias("spread"))
    return cells.groupBy(g.div(F.col("cx"), 8).alias("tx"), g.div(F.col("cy"), 8).alias("ty")).agg(F.count("*").alias("area"), F.sum(g.div(F.col("spread"), 3)).alias("inconsistency"), F.sum(F.col("n") - 1).alias("again"))


@C.add("pg", """w AS (SELECT *, CAST(greatest(0,floor((1-sqrt((qx*qx+qy*qy)::DOUBLE)/24)*1000000)) AS BIGINT) AS k FROM pg);;
 SELECT gx, gy, round(CAST(sum(vz*k) AS DOUBLE)/CAST(sum(k) AS DOUBLE),6) AS z, CAST(sum(k) AS BIGINT) AS weight, count(*) AS n FROM w WHERE k>0 GROUP BY 1,2""")
def blend_surface(spark, d):
    """Height of the blended surface: points weigh less towards their patch's rim. Weights are whole micro-units, so sums have no order."""
    k = F.greatest(F.lit(0), F.floor((1 - g.length(g.cols("qx qy")) / 24) * 1_000_000)).cast("long")
    w = V.placed_points(spark, d).withColumn("k", k).where("k > 0")
    return w.groupBy("gx", "gy").agg(R(F.sum(F.col("vz") * F.col("k")).cast("double") / F.sum("k").cast("double")).alias("z"), F.sum("k").alias("weight"), F.count("*").alias("n"))


@C.add("pg", """SELECT CAST(floor(sqrt(((l.vx-r.vx)*(l.vx-r.vx)+(l.vy-r.vy)*(l.vy-r.vy)+(l.vz-r.vz)*(l.vz-r.vz))::DOUBLE)) AS BIGINT) AS bin, count(*) AS n
 FROM pg l JOIN pg r ON l.gx=r.gx AND l.gy=r.gy AND l.pid<r.pid GROUP BY 1""")
def distance_histogram(spark, d):
    p = V.placed_points(spark, d)
    l, r = p.alias("l"), p.alias("r")
    same = (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy")) & (F.col("l.pid") < F.col("r.pid"))
    return l.join(r, same).groupBy(F.floor(g.distance(g.cols("vx vy vz", "l."), g.cols("vx vy vz", "r."))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@C.add("surf", """s AS (SELECT file, count(*) AS n FROM surf GROUP BY file), r AS (SELECT n, row_number() OVER (ORDER BY n, file) AS k, count(*) OVER () AS m FROM s);;
 SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS sets, count(*) FILTER (n>300) AS large, CAST(max(CASE WHEN k=(m+1)//2 THEN n END)+max(CASE WHEN k=m//2+1 THEN n END) AS BIGINT)//2 AS median FROM r""")
def size_stats(spark, d):
    """Points in all sets, number of sets, of large ones, and the median size (whole mean of the middle two)."""
    s = V.point_sets(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    sizes = s.groupBy("n").agg(F.count("*").alias("k"))  # few different sizes: their running count finds the middle
    w = Window.orderBy("n")
    run = sizes.withColumn("upto", F.sum("k").over(w)).crossJoin(F.broadcast(s.agg(F.count("*").alias("m"))))
    at = lambda p: F.min(F.when(F.col("upto") >= p, F.col("n")))
    m = F.col("m")
    return run.agg(F.sum(F.col("n") * F.col("k")).alias("total"), F.max("m").alias("sets"), F.sum(F.when(F.col("n") > 300, F.col("k")).otherwise(0)).alias("large"), g.div(at(F.floor((m + 1) / 2)) + at(F.floor(m / 2) + 1), 2).alias("median"))


@C.add("sample", "SELECT score AS value, count(*) AS n, count(DISTINCT file) AS files FROM sample GROUP BY 1")
def value_frequency(spark, d):
    return V.samples(spark, d).groupBy(F.col("score").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@C.add("sample", "SELECT file, max(score) AS best, count(*) AS n, arg_min(iter, (-score, iter)) AS first_best FROM sample GROUP BY file")
def best_score_per_file(spark, d):
    return V.samples(spark, d).groupBy("file").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.min_by("iter", F.struct(-F.col("score"), "iter")).alias("first_best"))


@C.add("edge", """o AS (SELECT p, count(*) AS seen, count(*) FILTER (w>8) AS bad FROM (SELECT p1 AS p,w FROM edge UNION ALL SELECT p2,w FROM edge) GROUP BY p);;
 SELECT p, seen, bad, round(bad/seen::DOUBLE,6) AS ratio FROM o ORDER BY bad/seen::DOUBLE DESC, p LIMIT 30""")
def ratio_score(spark, d):
    """The thirty vertices with the largest share of bad relations."""
    e = V.edges(spark, d)
    o = e.select(F.col("p1").alias("p"), "w").union(e.select("p2", "w")).groupBy("p").agg(F.count("*").alias("seen"), F.count_if(F.col("w") > 8).alias("bad"))
    return o.withColumn("ratio", F.col("bad") / F.col("seen")).orderBy(F.desc("ratio"), "p").limit(30).select("p", "seen", "bad", R("ratio").alias("ratio"))


@C.add("sample", """p AS (SELECT file, iter%7 AS run, count(*) AS n, avg(score) AS s FROM sample GROUP BY 1,2);; SELECT file, CAST(sum(n) AS BIGINT) AS n, round(sum(n*s)/sum(n),4) AS score FROM p GROUP BY file""")
def combine_scores(spark, d):
    """Mean scores of several runs, weighted by their numbers of samples."""
    p = V.samples(spark, d).groupBy("file", (F.col("iter") % 7).alias("run")).agg(F.count("*").alias("n"), F.avg("score").alias("s"))
    return p.groupBy("file").agg(R(F.sum(F.col("n") * F.col("s")) / F.sum("n"), 4).alias("score"), F.sum("n").alias("n"))


@C.add("surf", "SELECT file, count(*) AS volume, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM surf GROUP BY file HAVING count(*)>100")
def region_volume_and_extent(spark, d):
    ends = [f(a).alias(f"{a}{k}") for a in "xyz" for f, k in ((F.min, "min"), (F.max, "max"))]
    return V.point_sets(spark, d).groupBy("file").agg(F.count("*").alias("volume"), *ends).where("volume > 100")


@C.add("vox", "SELECT z//16 AS slab, count(*) FILTER (v=255) AS dense, count(*) FILTER (g>=160) AS bright, count(*) AS n FROM vox GROUP BY 1")
def class_counts(spark, d):
    return V.voxels(spark, d).groupBy(g.div(F.col("z"), 16).alias("slab")).agg(F.count_if(F.col("v") == 255).alias("dense"), F.count_if(F.col("g") >= 160).alias("bright"), F.count("*").alias("n"))


@C.add("pg", "SELECT pid, round(count(*)*7.91*7.91/1e8,8) AS cm2, CAST(sum(count(*)) OVER (ORDER BY pid) AS BIGINT) AS so_far FROM pg GROUP BY pid")
def painted_area(spark, d):
    """Area of each patch and the points painted so far, in patch order."""
    n = V.placed_points(spark, d).groupBy("pid").agg(F.count("*").alias("n"))
    return running_sum(n, "pid", F.col("n"), "so_far").select("pid", R(F.col("n") * 7.91 * 7.91 / 1e8, 8).alias("cm2"), "so_far")


@C.add("pp", """s AS (SELECT DISTINCT vz, pid FROM pp), b AS (SELECT vz, min(vx) AS x0, max(vx) AS x1, count(*) AS n FROM pp GROUP BY vz);;
 SELECT b.vz, n, (SELECT count(*) FROM s WHERE s.vz=b.vz) AS patches, min(x0) OVER (ORDER BY b.vz) AS x0, max(x1) OVER (ORDER BY b.vz) AS x1 FROM b""")
def slice_patches(spark, d):
    """Patches seen in each slice and the box of all slices so far; slices are few after the first aggregation."""
    b = V.patch_points(spark, d).groupBy("vz").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("patches"), F.min("vx").alias("x0"), F.max("vx").alias("x1"))
    w = Window.orderBy("vz")
    return b.select("vz", "n", "patches", F.min("x0").over(w).alias("x0"), F.max("x1").over(w).alias("x1"))


@C.add("pp", "SELECT vx//8 AS x, vy//8 AS y, vz//8 AS z, count(*) AS n, count(DISTINCT pid) AS patches FROM pp WHERE abs(qx)<=1 AND abs(qy)<=1 GROUP BY 1,2,3 HAVING count(*)>1")
def duplicate_centres(spark, d):
    key = [g.div(F.col(f"v{a}"), 8).alias(a) for a in "xyz"]
    return V.patch_points(spark, d).where("abs(qx) <= 1 and abs(qy) <= 1").groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("pid").alias("patches")).where("n > 1")


@C.add("edge pp", """c AS (SELECT pid, vx, vy FROM pp WHERE qx=0 AND qy=0);;
 SELECT p1 AS p, count(*) AS neighbours, count(*) FILTER (sqrt(((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy))::DOUBLE)>200+w) AS implausible
 FROM edge JOIN c a ON a.pid=p1 JOIN c b ON b.pid=p2 GROUP BY p1""")
def neighbour_plausibility(spark, d):
    """Neighbours whose centres are further apart than their sizes allow."""
    c = V.patch_points(spark, d).where("qx = 0 and qy = 0").select("pid", "vx", "vy")
    a = c.select(F.col("pid").alias("p1"), F.col("vx").alias("ax"), F.col("vy").alias("ay"))
    b = c.select(F.col("pid").alias("p2"), F.col("vx").alias("bx"), F.col("vy").alias("by"))
    far = g.distance(g.cols("ax ay"), g.cols("bx by")) > 200 + F.col("w")
    return V.edges(spark, d).join(a, "p1").join(b, "p2").groupBy(F.col("p1").alias("p")).agg(F.count("*").alias("neighbours"), F.count_if(far).alias("implausible"))


@C.add("vox", """SELECT z//16 AS slab, CAST(quantile_disc(g,0.25) AS BIGINT) AS q1, CAST(quantile_disc(g,0.5) AS BIGINT) AS q2, CAST(quantile_disc(g,0.75) AS BIGINT) AS q3 FROM vox GROUP BY 1""")
def slab_quartiles(spark, d):
    q = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by g) as bigint)")
    return V.voxels(spark, d).groupBy(g.div(F.col("z"), 16).alias("slab")).agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
