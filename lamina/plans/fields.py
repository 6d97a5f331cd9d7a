"""Frames, blocks, rasters and volume fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import halo as H
from lamina.operators import voxel as X
from lamina.operators.mesh import gathered
from lamina.plans.catalog import Catalog
from lamina.plans.voxels import _sobel_sql
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)
AXES = list(X.AXES)
FRAME = g.plane_basis((3, 1, 2), (-1, 4, 1))


def _dot(v, names="vx vy vz"):
    return "+".join(f"{n}*({k})" for n, k in zip(names.split(), v, strict=True))


@C.add("pp", f"SELECT pid,qx,qy,{','.join(f'round(({_dot(v)})/1000.0::DOUBLE,4)+0 AS {n}' for v, n in zip(FRAME, 'uvw', strict=True))}, vx::DOUBLE AS x, vy::DOUBLE AS y, vz::DOUBLE AS z FROM pp")
def frame_round_trip(spark, d):
    """Coordinates in the frame of a plane, and back by the inverse frame."""
    p = V.patch_points(spark, d)
    local = [sum(((c * k) for c, k in zip(g.cols("vx vy vz"), v, strict=True)), F.lit(0)) / 1000.0 for v in FRAME]
    p = p.select("pid", "qx", "qy", *(c.alias(n) for n, c in zip("uvw", local, strict=True)))
    back = g.unproject(g.cols("u v w"), FRAME)
    return p.select("pid", "qx", "qy", *((R(n, 4) + F.lit(0)).alias(n) for n in "uvw"), *((R(c, 4) + F.lit(0)).alias(n) for n, c in zip("xyz", back, strict=True)))


@C.add("pp", """n AS (SELECT pid,qx,qy,vx/sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE) AS a,vy/sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE) AS b,vz/sqrt((vx*vx+vy*vy+vz*vz)::DOUBLE) AS c FROM pp);;
 SELECT pid,qx,qy,round(1-a*a/(1+c),6)+0 AS r00,round(-a*b/(1+c),6)+0 AS r01,round(-a,6)+0 AS r02,round(-a*b/(1+c),6)+0 AS r10,round(1-b*b/(1+c),6)+0 AS r11,round(-b,6)+0 AS r12,
 round(a,6)+0 AS r20,round(b,6)+0 AS r21,round(1-(a*a+b*b)/(1+c),6)+0 AS r22 FROM n""")
def rotation_to_axis(spark, d):
    """The rotation that turns each point's direction to the third axis; the oracle is its closed form."""
    r = g.rotation_between(g.cols("vx vy vz"), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    return V.patch_points(spark, d).select("pid", "qx", "qy", *((R(r[i][j]) + F.lit(0)).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


STRESS = "s AS (SELECT a.pid,a.qx,a.qy,a.vx,a.vy,a.vz,avg(pow(4-sqrt(((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)+(a.vz-b.vz)*(a.vz-b.vz))::DOUBLE),2)) AS stress FROM pp a JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON true JOIN pp b ON b.pid=a.pid AND b.qx=a.qx+dx AND b.qy=a.qy+dy GROUP BY ALL)"
LIMIT = 2.0


def stressed(points):
    """(pid, qx, qy, vx, vy, vz, stress): mean square of how far the links to direct mesh neighbours are from their length at rest, 4."""
    near = gathered(points, [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)], ["vx", "vy", "vz"]).where("vx_0 is not null")
    own = [F.col(f"v{a}_0") for a in "xyz"]
    off = [(4 - g.distance(own, [F.col(f"v{a}_{k}") for a in "xyz"])) ** 2 for k in range(1, 5)]
    total = sum((F.coalesce(o, F.lit(0.0)) for o in off), F.lit(0.0))
    links = sum((o.isNotNull().cast("int") for o in off), F.lit(0))
    return near.select("pid", "qx", "qy", *(c.alias(f"v{a}") for a, c in zip("xyz", own, strict=True)), (total / F.nullif(links, F.lit(0))).alias("stress")).where("stress is not null")


@C.add("pp", STRESS + f""", b AS (SELECT DISTINCT vx//16 AS x, vy//16 AS y, vz//16 AS z FROM s WHERE stress>{LIMIT} AND vx>=0 AND vy>=0 AND vz>=0);;
 SELECT DISTINCT x+i AS bx, y+j AS by, z+k AS bz FROM b, range(-1,2) p(i), range(-1,2) q(j), range(-1,2) r(k) WHERE x+i>=0 AND y+j>=0 AND z+k>=0""")
def stress_blocks(spark, d):
    """Blocks of 16 voxels around points of high stress, with the blocks next to them."""
    b = stressed(V.patch_points(spark, d)).where(F.col("stress") > LIMIT).where("vx >= 0 and vy >= 0 and vz >= 0")
    b = b.select(*(g.div(F.col(f"v{a}"), 16).alias(a) for a in "xyz")).distinct()
    span = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    for a in "xyz":
        b = b.withColumn("_o", F.explode(span)).withColumn(f"b{a}", F.col(a) + F.col("_o")).drop(a, "_o").where(F.col(f"b{a}") >= 0).distinct()
    return b.select("bx", "by", "bz")


@C.add("pp", STRESS + ";; SELECT pid, round(max(stress),6) AS most, count(*) AS n FROM s GROUP BY pid")
def greatest_stress(spark, d):
    return stressed(V.patch_points(spark, d)).groupBy("pid").agg(R(F.max("stress")).alias("most"), F.count("*").alias("n"))


@C.add("pp", """e AS (SELECT pid, max(qx)-min(qx)+1 AS w, max(qy)-min(qy)+1 AS h FROM pp GROUP BY pid), m AS (SELECT max(w) AS w, max(h) AS h FROM e);;
 SELECT pid, e.w, e.h, (m.w-e.w)//2 AS pad_left, m.w-e.w-(m.w-e.w)//2 AS pad_right, (m.h-e.h)//2 AS pad_top, m.h-e.h-(m.h-e.h)//2 AS pad_bottom FROM e, m""")
def centred_padding(spark, d):
    """How much each patch's raster is padded on each side to reach the largest width and height."""
    e = V.patch_points(spark, d).groupBy("pid").agg((F.max("qx") - F.min("qx") + 1).alias("w"), (F.max("qy") - F.min("qy") + 1).alias("h"))
    most = e.agg(F.struct(F.max("w").alias("w"), F.max("h").alias("h")).alias("m")).scalar()
    pads = []
    for c, low, high in (("w", "left", "right"), ("h", "top", "bottom")):
        gap = most[c] - F.col(c)
        pads += [g.div(gap, 2).alias(f"pad_{low}"), (gap - g.div(gap, 2)).alias(f"pad_{high}")]
    return e.select("pid", "w", "h", *pads)


@C.add("pg", """k AS (SELECT gx,gy,pid,vz,row_number() OVER (PARTITION BY gx,gy ORDER BY pid DESC) AS r FROM pg);;
 SELECT t.gx,t.gy,t.pid, CASE WHEN b.vz IS NULL THEN t.vz ELSE ((128+t.pid%64)*t.vz*100+(128-t.pid%64)*b.vz*100)//256 END AS shade FROM k t LEFT JOIN k b ON b.gx=t.gx AND b.gy=t.gy AND b.r=2 WHERE t.r=1""")
def composite_layers(spark, d):
    """The two uppermost patches of each cell blended by the upper one's opacity. Ranks of two at most are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("gx", "gy").orderBy(F.desc("pid")))
    two = V.placed_points(spark, d).withColumn("r", rank).where("r <= 2")
    of = lambda r: F.max(F.when(F.col("r") == r, F.struct("pid", "vz")))
    top = two.groupBy("gx", "gy").agg(of(1).alias("t"), of(2).alias("b"))
    b = F.col("b")
    alpha = 128 + F.col("t.pid") % 64
    mixed = g.div(alpha * F.col("t.vz") * 100 + (256 - alpha) * b["vz"] * 100, 256)
    return top.select("gx", "gy", F.col("t.pid").alias("pid"), F.when(b.isNull(), F.col("t.vz")).otherwise(mixed).alias("shade"))


@C.add("vox", _sobel_sql().replace("SELECT z,y,x,dz,dy,dx, CASE", "SELECT z,y,x,dz,dy,dx FROM (SELECT z,y,x,dz,dy,dx, CASE") + ") JOIN vox USING (z,y,x) WHERE v=255")
def masked_gradient(spark, d):
    """The gradient where the volume is set."""
    vox = V.voxels(spark, d)
    s = H.stencil(vox, "v", "d", 1, H.sobel, {f"d{a}": "long" for a in AXES})
    return s.join(vox.where("v = 255").select(*AXES), list(AXES), "left_semi").select(*AXES, "dz", "dy", "dx")


@C.add("vox", """o AS (SELECT dz,dy,dx,dz*dz+dy*dy+dx*dx AS d2 FROM range(-2,3) a(dz), range(-2,3) b(dy), range(-2,3) c(dx)),
 p AS (SELECT a.z,a.y,a.x,a.v,d2,sum(dz) AS sz,sum(dy) AS sy,sum(dx) AS sx,count(*) AS n FROM (SELECT vox.*, o.*, z+dz AS tz, y+dy AS ty, x+dx AS tx FROM vox, o) a JOIN vox b ON b.z=tz AND b.y=ty AND b.x=tx AND a.v<>b.v GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY z,y,x ORDER BY d2) AS r FROM p), f AS (SELECT z,y,x,v,CASE WHEN v=0 THEN 1 ELSE -1 END AS s,sx,sy,sz,sqrt(d2::DOUBLE) AS d,n FROM k WHERE r=1);;
 SELECT z,y,x,CAST(trunc(round(s*sx/d/n*127,6)) AS BIGINT) AS qx,CAST(trunc(round(s*sy/d/n*127,6)) AS BIGINT) AS qy,CAST(trunc(round(s*sz/d/n*127,6)) AS BIGINT) AS qz,255-v AS outside FROM f""")
def quantised_field(spark, d):
    """The direction field in signed bytes, with a channel that is zero inside the surface."""
    f = X.direction_field(V.voxels(spark, d))
    return f.select(*AXES, *(F.round(F.col(f"f{a}") * 127, 6).cast("long").alias(f"q{a}") for a in "xyz"), (255 - F.col("v")).alias("outside"))


@C.add("vox", """o AS (SELECT dz,dy,dx,CAST(1000000//(dz*dz+dy*dy+dx*dx) AS BIGINT) AS w FROM range(-3,4) a(dz), range(-3,4) b(dy), range(-3,4) c(dx) WHERE dz*dz+dy*dy+dx*dx>0);;
 SELECT a.z,a.y,a.x,CAST(sum(w*dz) AS BIGINT) AS fz,CAST(sum(w*dy) AS BIGINT) AS fy,CAST(sum(w*dx) AS BIGINT) AS fx FROM (SELECT z,y,x,dz,dy,dx,w,z+dz AS tz,y+dy AS ty,x+dx AS tx FROM vox, o WHERE v=0) a JOIN vox b ON b.z=tz AND b.y=ty AND b.x=tx AND b.v=255 GROUP BY 1,2,3""")
def attraction_field(spark, d):
    """Pull of the set voxels within three steps on each other voxel, by inverse square distance in micro-units."""
    vox = V.voxels(spark, d)
    w = g.div(F.lit(1_000_000), 1) / (F.col("oz") * F.col("oz") + F.col("oy") * F.col("oy") + F.col("ox") * F.col("ox"))
    s = X.scatter(vox.where("v = 255"), X.neighbours(3, False), []).withColumn("w", F.floor(w).cast("long"))
    s = s.groupBy(*AXES).agg(*(F.sum(-F.col("w") * F.col(f"o{a}")).alias(f"f{a}") for a in AXES))
    return s.join(vox.where("v = 0").select(*AXES), AXES, "left_semi").select(*AXES, "fz", "fy", "fx")


@C.add("vox", "SELECT z//16 AS image, (z%16)//4*8+y AS r, z%4*8+CASE WHEN f=1 THEN 7-x ELSE x END AS c, f::BIGINT AS flipped, g FROM vox, range(0,2) t(f)")
def mosaic(spark, d):
    """Slices laid out as images of four by four, plain and mirrored."""
    both = V.voxels(spark, d).withColumn("flipped", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    x = F.when(F.col("flipped") == 1, 7 - F.col("x")).otherwise(F.col("x"))
    return both.select(g.div(F.col("z"), 16).alias("image"), (g.div(F.col("z") % 16, 4) * 8 + F.col("y")).alias("r"), (F.col("z") % 4 * 8 + x).alias("c"), "flipped", "g")


@C.add("vox", "SELECT z, y, string_agg(g::VARCHAR, ',' ORDER BY x) AS run FROM vox WHERE x BETWEEN 2 AND 5 GROUP BY z, y")
def run_read(spark, d):
    """Four values along the last axis from each place 2 on."""
    runs = V.voxels(spark, d).where("x between 2 and 5").groupBy("z", "y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("r"))
    return runs.select("z", "y", F.array_join(F.transform("r", lambda e: e["g"].cast("string")), ",").alias("run"))


def _gap_sql(axis: str, other: str) -> str:
    at = f"CASE WHEN v IS NOT NULL THEN {axis} END"
    return (
        f"n{axis} AS (SELECT *, last_value({at} IGNORE NULLS) OVER a AS p0, last_value(v IGNORE NULLS) OVER a AS v0, first_value({at} IGNORE NULLS) OVER b AS p1, first_value(v IGNORE NULLS) OVER b AS v1 FROM f"
        f" WINDOW a AS (PARTITION BY pid,{other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY pid,{other} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
        f" g{axis} AS (SELECT pid,qx,qy,v,p1-p0 AS gap,v0+(v1-v0)*({axis}-p0)/nullif(p1-p0,0)::DOUBLE AS t FROM n{axis})"
    )


@C.add("pp", "f AS (SELECT pid, qx, qy, CASE WHEN (qx*7+qy*13)%3=0 THEN NULL ELSE vz END AS v FROM pp), " + _gap_sql("qx", "qy") + ", " + _gap_sql("qy", "qx") + """;;
 SELECT pid,qx,qy,round(CASE WHEN a.v IS NOT NULL THEN a.v WHEN a.gap IS NULL AND b.gap IS NULL THEN NULL WHEN b.gap IS NULL OR a.gap<=b.gap THEN a.t ELSE b.t END,6)::DOUBLE AS v FROM gqx a JOIN gqy b USING (pid,qx,qy)""")
def gap_interpolate_shorter(spark, d):
    """Blank mesh points filled linearly across the shorter of the gaps along both mesh axes (ties: along x)."""
    f = V.patch_points(spark, d).select("pid", "qx", "qy", F.when((F.col("qx") * 7 + F.col("qy") * 13) % 3 == 0, None).otherwise(F.col("vz")).alias("v"))
    for axis, other in (("qx", "qy"), ("qy", "qx")):
        row = Window.partitionBy("pid", other).orderBy(axis)
        back, fore = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(0, Window.unboundedFollowing)
        at = F.when(F.col("v").isNotNull(), F.col(axis))
        f = f.withColumns({"p0": F.last(at, True).over(back), "v0": F.last("v", True).over(back), "p1": F.first(at, True).over(fore), "v1": F.first("v", True).over(fore)})
        gap = F.col("p1") - F.col("p0")
        f = f.withColumns({f"gap_{axis}": gap, f"t_{axis}": F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(axis) - F.col("p0")) / F.nullif(gap, F.lit(0))}).drop("p0", "v0", "p1", "v1")
    along_x = F.col("gap_qy").isNull() | (F.col("gap_qx") <= F.col("gap_qy"))
    filled = F.when(along_x & F.col("gap_qx").isNotNull(), F.col("t_qx")).otherwise(F.col("t_qy"))
    return f.select("pid", "qx", "qy", R(F.coalesce(F.col("v").cast("double"), filled)).alias("v"))
