"""Volume filters, morphology and mesh stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import halo as H
from lamina.operators import voxel as X
from lamina.operators.graph import components
from lamina.operators.mesh import normals, upsample
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)
AXES = list(X.AXES)
FACE_SQL = "(VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) f(dz,dy,dx)"


@C.add("vox", "SELECT z,y,x, CASE WHEN g<=135 THEN 0 ELSE 1 END AS c FROM vox")
def threshold(spark, d):
    return V.voxels(spark, d).select(*AXES, F.when(F.col("g") <= 135, 0).otherwise(1).cast("long").alias("c"))


@C.add("vox", f"""s AS (SELECT DISTINCT z+dz AS z,y+dy AS y,x+dx AS x FROM vox, {FACE_SQL} WHERE v=255);;
 SELECT vox.z,vox.y,vox.x, CAST(v=255 OR (g>=110 AND s.z IS NOT NULL) AS BIGINT) AS c FROM vox LEFT JOIN s USING (z,y,x)""")
def conditional_dilation(spark, d):
    """One growth step into face neighbours that are bright enough."""
    grown = X.dilate(V.voxels(spark, d), "v", F.col("v") == 255, F.col("g") >= 110)
    return grown.select(*AXES, F.col("grown").cast("long").alias("c"))


@C.add("vox", f"""l AS (SELECT z,y,x,g//64+1 AS label FROM vox WHERE v=255), s AS (SELECT z+dz AS z,y+dy AS y,x+dx AS x, arg_min(label,(dz,dy,dx)) AS label FROM l, {FACE_SQL} GROUP BY 1,2,3);;
 SELECT vox.z,vox.y,vox.x, coalesce(l.label,s.label,0) AS label FROM vox LEFT JOIN l USING (z,y,x) LEFT JOIN s ON s.z=vox.z AND s.y=vox.y AND s.x=vox.x""")
def dilate_labels(spark, d):
    """Labels spread to unlabelled face neighbours; the first direction in order wins."""
    vox = V.voxels(spark, d)
    own = vox.where("v = 255").select(*AXES, (g.div(F.col("g"), 64) + 1).alias("label"))
    sent = X.scatter(own, X.FACES, [F.col("label").alias("near")]).groupBy(*AXES).agg(F.min_by("near", F.struct("oz", "oy", "ox")).alias("near"))
    return vox.select(*AXES).join(own, AXES, "left").join(sent, AXES, "left").select(*AXES, F.coalesce("label", "near", F.lit(0)).alias("label"))


def _line_sql(value: str, axis: str, form: str, source: str, keep: str) -> str:
    part = ",".join(a for a in "zyx" if a != axis)
    lo, hi = f"coalesce(lag({value}) OVER w,lead({value}) OVER w,{value})", f"coalesce(lead({value}) OVER w,lag({value}) OVER w,{value})"
    expr = {"s": f"{lo}+2*{value}+{hi}", "d": f"{lo}-{hi}"}[form]
    return f"SELECT z,y,x,{keep}{expr} AS {value} FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY {axis})"


def _sobel_sql() -> str:
    out = []
    for axis in "zyx":
        src = f"(SELECT z,y,x,v AS t FROM vox) q{axis}"
        for a in "zyx":
            src = f"({_line_sql('t', a, 'd' if a == axis else 's', src, '')}) q{axis}{a}"
        out.append(f"s{axis} AS (SELECT z,y,x,t AS d{axis} FROM {src})")
    return ", ".join(out) + ";; SELECT z,y,x,dz,dy,dx, CASE WHEN 2*dz+dy-dx>0 AND dz*dz+dy*dy+dx*dx>150*150 THEN 255 ELSE 0 END AS edge FROM sz JOIN sy USING (z,y,x) JOIN sx USING (z,y,x)"


@C.add("vox", _sobel_sql())
def sobel_edges(spark, d):
    """Gradient by three separable passes inside blocks; an edge is strong and points along the sheet's normal (2, 1, -1) in z, y, x."""
    s = H.stencil(V.voxels(spark, d), "v", "d", 1, H.sobel, {f"d{a}": "long" for a in AXES})
    n2 = F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    edge = F.when((2 * F.col("dz") + F.col("dy") - F.col("dx") > 0) & (n2 > 150 * 150), 255).otherwise(0)
    return s.select(*AXES, "dz", "dy", "dx", edge.cast("long").alias("edge"))


@C.add("vox", f"""o AS (SELECT dz,dy,dx, CASE abs(dz)+abs(dy)+abs(dx) WHEN 0 THEN -88 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 2 END AS w FROM range(-1,2) a(dz), range(-1,2) b(dy), range(-1,2) c(dx)),
 l AS (SELECT a.z,a.y,a.x, sum(w*b.g) AS s, count(*) AS n FROM vox a, o, vox b WHERE b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3);;
 SELECT z,y,x,CAST(least(greatest(128+s//10,0),255) AS BIGINT) AS l FROM l WHERE n=27""")
def laplacian(spark, d):
    """27-point Laplacian of the interior, scaled to a byte."""
    weight = F.element_at(F.array(F.lit(-88), F.lit(6), F.lit(3), F.lit(2)), (F.abs("oz") + F.abs("oy") + F.abs("ox") + 1).cast("int"))
    s = X.scatter(V.voxels(spark, d), X.neighbours(1), [F.col("g")]).groupBy(*AXES).agg(F.sum(weight * F.col("g")).alias("s"), F.count("*").alias("n"))
    return s.where("n = 27").select(*AXES, F.least(F.greatest(128 + g.div(F.col("s"), 10), F.lit(0)), F.lit(255)).alias("l"))


@C.add("vox", """a AS (SELECT z,y,x,coalesce(lag(g,2) OVER w,lead(g,2) OVER w,g)+4*coalesce(lag(g) OVER w,lead(g) OVER w,g)+6*g+4*coalesce(lead(g) OVER w,lag(g) OVER w,g)+coalesce(lead(g,2) OVER w,lag(g,2) OVER w,g) AS s FROM vox WINDOW w AS (PARTITION BY y,x ORDER BY z));;
 SELECT z,y,x,s//16 AS s FROM a""")
def gaussian_line(spark, d):
    """A Pascal row of five along z, divided as a whole."""
    return X.along(V.voxels(spark, d), "z", "s", "g", {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}).select(*AXES, g.div(F.col("s"), 16).alias("s"))


@C.add("vox", """SELECT a.z,a.y,a.x, CAST(255*count(*) FILTER (b.g<=a.g)//count(*) AS BIGINT) AS e FROM vox a JOIN vox b ON b.z BETWEEN a.z-2 AND a.z+2 AND b.y=a.y AND b.x BETWEEN a.x-2 AND a.x+2 GROUP BY a.z,a.y,a.x,a.g""")
def local_equalisation(spark, d):
    """Rank of each voxel among its 5 x 5 neighbours in z and x, as a byte."""
    square = [(z, 0, x) for z in range(-2, 3) for x in range(-2, 3)]
    return H.stencil(V.voxels(spark, d), "g", "e", 2, H.rank_among(square, 2))


@C.add("vox", """o AS (SELECT dz,dy,dx,dz*dz+dy*dy+dx*dx AS d2 FROM range(-2,3) a(dz), range(-2,3) b(dy), range(-2,3) c(dx)),
 p AS (SELECT a.z,a.y,a.x,a.v,d2,sum(dz) AS sz,sum(dy) AS sy,sum(dx) AS sx,count(*) AS n FROM (SELECT vox.*, o.*, z+dz AS tz, y+dy AS ty, x+dx AS tx FROM vox, o) a JOIN vox b ON b.z=tz AND b.y=ty AND b.x=tx AND a.v<>b.v GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY z,y,x ORDER BY d2) AS r FROM p);;
 SELECT z,y,x,round(CASE WHEN v=0 THEN 1 ELSE -1 END*sx/sqrt(d2::DOUBLE)/n,6)+0 AS fx,round(CASE WHEN v=0 THEN 1 ELSE -1 END*sy/sqrt(d2::DOUBLE)/n,6)+0 AS fy,round(CASE WHEN v=0 THEN 1 ELSE -1 END*sz/sqrt(d2::DOUBLE)/n,6)+0 AS fz FROM k WHERE r=1""")
def direction_field(spark, d):
    f = X.direction_field(V.voxels(spark, d))
    return f.select(*AXES, *((R(c) + F.lit(0)).alias(c) for c in ("fx", "fy", "fz")))


KERNEL = [(z, y, x, int(round(w * 1_000_000))) for z, y, x, w in g.gaussian(1, 0.8)]


@C.add("vox", "k AS (SELECT * FROM (VALUES " + ",".join(map(str, KERNEL)) + """) t(dz,dy,dx,w));;
 SELECT a.z,a.y,a.x,CAST(sum(w*b.g)//1000000 AS BIGINT) AS s FROM vox a, k, vox b WHERE b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3""")
def gaussian_cube(spark, d):
    """A 27-point Gaussian in micro-units."""
    by_ring = {sum(map(abs, k[:3])): k[3] for k in KERNEL}
    ring = (F.abs("oz") + F.abs("oy") + F.abs("ox")).cast("int")
    weight = F.element_at(F.array(*(F.lit(by_ring[i]).cast("long") for i in range(4))), ring + 1)
    s = X.scatter(V.voxels(spark, d), X.neighbours(1), [F.col("g")]).groupBy(*AXES).agg(F.sum(weight * F.col("g")).alias("s"))
    return s.join(V.voxels(spark, d).select(*AXES), AXES, "left_semi").select(*AXES, g.div(F.col("s"), 1_000_000).alias("s"))


@C.add("vox", "SELECT a.z,a.y,a.x,round(avg(b.g),6) AS m, count(*) AS n FROM vox a JOIN vox b ON b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY 1,2,3")
def box_mean(spark, d):
    """Mean of the neighbours that exist (clipped at the borders), by running windows along each axis: sums and counts are separable."""
    df = V.voxels(spark, d).withColumns({"s": F.col("g"), "n": F.lit(1)})
    for a in AXES:
        w = X.line(a).rangeBetween(-1, 1)
        df = df.withColumns({"s": F.sum("s").over(w), "n": F.sum("n").over(w)})
    return df.select(*AXES, R(F.col("s") / F.col("n")).alias("m"), "n")


@C.add("vox", f"""n AS (SELECT a.z,a.y,a.x,count(*) AS n FROM vox a, {FACE_SQL}, vox b WHERE a.v=255 AND b.v=255 AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3);;
 SELECT z,y,x FROM vox WHERE v=255 AND (z,y,x) IN (SELECT n.z+dz,n.y+dy,n.x+dx FROM n, {FACE_SQL} WHERE n.n>1)""")
def drop_isolated(spark, d):
    """Edge voxels with a neighbour that itself has several; all voxels are judged at once."""
    on = V.voxels(spark, d).where("v = 255").select(*AXES)
    n = X.scatter(on, X.FACES, []).groupBy(*AXES).agg(F.count("*").alias("n")).join(on, AXES, "left_semi").where("n > 1")
    return on.join(X.scatter(n, X.FACES, []).select(*AXES).distinct(), AXES, "left_semi")


@C.add("vox", """SELECT z,y,x FROM vox a WHERE v=255 AND g>=150 AND EXISTS (SELECT 1 FROM vox b WHERE b.v=0 AND b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 AND abs(a.z-b.z)+abs(a.y-b.y)+abs(a.x-b.x)<=2)""")
def surface_voxels(spark, d):
    """Bright set voxels with an empty one among their face and edge neighbours."""
    near = [o for o in X.neighbours(1, False) if sum(map(abs, o)) <= 2]
    vox = V.voxels(spark, d)
    empty = X.scatter(vox.where("v = 0"), near, []).select(*AXES).distinct()
    return vox.where("v = 255 and g >= 150").join(empty, AXES, "left_semi").select(*AXES)


@C.add("vox", """f AS (SELECT a.z,a.y,a.x,count(*) AS n,sum(b.z-a.z) AS sz,sum(b.y-a.y) AS sy,sum(b.x-a.x) AS sx FROM vox a JOIN vox b ON b.v=255 AND b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 WHERE a.v=255 GROUP BY 1,2,3);;
 SELECT z,y,x,n,CAST(sz*sz+sy*sy+sx*sx AS BIGINT) AS d2 FROM f WHERE n>=10 AND sz*sz+sy*sy+sx*sx<29""")
def flat_voxels(spark, d):
    """Set voxels with enough set neighbours whose centroid is near."""
    on = V.voxels(spark, d).where("v = 255").select(*AXES)
    s = X.scatter(on, X.neighbours(1), []).groupBy(*AXES).agg(F.count("*").alias("n"), *(F.sum(-F.col(f"o{a}")).alias(f"s{a}") for a in AXES))
    d2 = F.col("sz") * F.col("sz") + F.col("sy") * F.col("sy") + F.col("sx") * F.col("sx")
    return s.join(on, AXES, "left_semi").withColumn("d2", d2).where("n >= 10 and d2 < 29").select(*AXES, "n", "d2")


@C.add("pp", """s AS (SELECT a.pid,a.qx,a.qy, sum(pow(sqrt(((a.vx-b.vx)*(a.vx-b.vx)+(a.vy-b.vy)*(a.vy-b.vy)+(a.vz-b.vz)*(a.vz-b.vz))::DOUBLE)/(4*sqrt(((a.qx-b.qx)*(a.qx-b.qx)+(a.qy-b.qy)*(a.qy-b.qy))::DOUBLE))-1,2))/count(*) AS strain
 FROM pp a JOIN pp b ON a.pid=b.pid AND b.qx BETWEEN a.qx-1 AND a.qx+1 AND b.qy BETWEEN a.qy-1 AND a.qy+1 AND (a.qx<>b.qx OR a.qy<>b.qy) GROUP BY 1,2,3);;
 SELECT pid,qx,qy,round(strain,6) AS strain, CAST(least(255,floor(round(20000*strain,4))) AS BIGINT) AS grey FROM s""")
def mesh_stress(spark, d):
    """Mean squared strain of the springs to the eight neighbours, and its grey level."""
    o = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)))
    p = V.patch_points(spark, d)
    sent = p.withColumn("o", F.explode(o)).select("pid", (F.col("qx") + F.col("o.i")).alias("qx"), (F.col("qy") + F.col("o.j")).alias("qy"), *(F.col(f"v{k}").alias(f"b{k}") for k in "xyz"), g.length([F.col("o.i"), F.col("o.j")]).alias("r"))
    j = p.join(sent, ["pid", "qx", "qy"])
    strain = F.pow(g.distance(g.cols("vx vy vz"), g.cols("bx by bz")) / (4 * F.col("r")) - 1, F.lit(2))
    s = j.groupBy("pid", "qx", "qy").agg((F.sum(strain) / F.count("*")).alias("s"))
    return s.select("pid", "qx", "qy", R("s").alias("strain"), F.least(F.lit(255), F.floor(R(20000 * F.col("s"), 4))).cast("long").alias("grey"))


NORMAL = """n AS (SELECT a.pid,a.qx,a.qy, coalesce(e.vx,a.vx)-coalesce(w.vx,a.vx) AS ux, coalesce(e.vy,a.vy)-coalesce(w.vy,a.vy) AS uy, coalesce(e.vz,a.vz)-coalesce(w.vz,a.vz) AS uz,
 coalesce(s.vx,a.vx)-coalesce(n.vx,a.vx) AS tx, coalesce(s.vy,a.vy)-coalesce(n.vy,a.vy) AS ty, coalesce(s.vz,a.vz)-coalesce(n.vz,a.vz) AS tz
 FROM pp a LEFT JOIN pp e ON e.pid=a.pid AND e.qx=a.qx+1 AND e.qy=a.qy LEFT JOIN pp w ON w.pid=a.pid AND w.qx=a.qx-1 AND w.qy=a.qy
 LEFT JOIN pp s ON s.pid=a.pid AND s.qx=a.qx AND s.qy=a.qy+1 LEFT JOIN pp n ON n.pid=a.pid AND n.qx=a.qx AND n.qy=a.qy-1 WHERE (e.vx IS NOT NULL OR w.vx IS NOT NULL) AND (s.vx IS NOT NULL OR n.vx IS NOT NULL)),
 c AS (SELECT pid,qx,qy,uy*tz-uz*ty AS x, uz*tx-ux*tz AS y, ux*ty-uy*tx AS z FROM n), m AS (SELECT *, nullif(sqrt((x*x+y*y+z*z)::DOUBLE),0) AS l FROM c)"""


@C.add("pp", NORMAL + ";; SELECT pid,qx,qy,round(x/l,6)+0 AS nx,round(y/l,6)+0 AS ny,round(z/l,6)+0 AS nz FROM m")
def surface_normals(spark, d):
    return normals(V.patch_points(spark, d)).select("pid", "qx", "qy", *((R(f"n{a}") + F.lit(0)).alias(f"n{a}") for a in "xyz"))


@C.add("pp", """q AS (SELECT a.pid,a.qx,a.qy,a.vz AS z00,b.vz AS z10,c.vz AS z01,e.vz AS z11 FROM pp a JOIN pp b ON b.pid=a.pid AND b.qx=a.qx+1 AND b.qy=a.qy JOIN pp c ON c.pid=a.pid AND c.qx=a.qx AND c.qy=a.qy+1 JOIN pp e ON e.pid=a.pid AND e.qx=a.qx+1 AND e.qy=a.qy+1);;
 SELECT pid, 4*qx+i AS x, 4*qy+j AS y, ((4-i)*(4-j)*z00+i*(4-j)*z10+(4-i)*j*z01+i*j*z11)/16.0::DOUBLE AS z FROM q, range(4) a(i), range(4) b(j)""")
def upsample_mesh(spark, d):
    """Sixteen bilinear points for each quad with all four corners."""
    return upsample(V.patch_points(spark, d), ["vz"], 4).select("pid", "x", "y", F.col("vz").alias("z"))


def regions(on):
    """(label, volume, z0, y0, x0, z1, y1, x1): face-connected regions of the given voxels, by least voxel number."""
    n = on.select(*AXES, (F.col("z") * 64 + F.col("y") * 8 + F.col("x")).alias("id"))
    e = X.scatter(n, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], [F.col("id").alias("p1")]).join(n.withColumnRenamed("id", "p2"), AXES).select("p1", "p2")
    ends = [f(a).alias(f"{a}{k}") for k, f in ((0, F.min), (1, F.max)) for a in AXES]
    return n.join(components(e), "id", "left").groupBy(F.coalesce("component", "id").alias("label")).agg(F.count("*").alias("volume"), *ends)


@C.add()
def label_voxels(spark, d):
    """Face-connected regions by least voxel number, with volume and extent."""
    return regions(V.voxels(spark, d).where("v = 255")).select("label", "volume", "z0", "z1")


@C.add()
def class_regions(spark, d):
    """Face-connected regions of the voxels of one class (grey 128 to 191), those above a volume only, with their boxes."""
    return regions(V.voxels(spark, d).where("g div 64 = 2")).where("volume > 8")
