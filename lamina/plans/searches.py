"""Queries of walks, removal, connected orders, paths and the cage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import cage, spanning, walks
from lamina.operators import graph as G
from lamina.plans.catalog import Catalog
from lamina.plans.graphs import BOTH, VISIT
from lamina.plans.voxels import NORMAL
from lamina.sources import text_tables as T
from lamina.sources import views as V
from lamina.sources.scratch import new_folder

C = Catalog()
R = lambda c, n=6: F.round(c, n)
CAGE, CELL = 8, 40  # the cage is so many vertices wide, and they stand so far apart


def cage_triangles(spark, d):
    """(tri, ax, ay, max, may, ...): two triangles for each square of suppliers, and where their corners move to."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    v = s.select("id", (CELL * (F.col("id") % CAGE)).alias("x"), (CELL * g.div(F.col("id"), CAGE)).alias("y"))
    v = v.withColumns({"mx": F.col("x") + F.col("id") * 7 % 5 - 2, "my": F.col("y") + F.col("id") * 11 % 7 - 3})
    squares = s.where(F.col("id") % CAGE < CAGE - 1).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    t = squares.select((2 * F.col("id") + F.col("i")).alias("tri"), (F.col("id") + F.when(F.col("i") == 1, CAGE + 1).otherwise(0)).alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + CAGE).alias("c"))
    for corner in "abc":
        t = t.join(v.select(F.col("id").alias(corner), *(F.col(n).alias(f"{p}{corner}{n[-1]}") for n, p in (("x", ""), ("y", ""), ("mx", "m"), ("my", "m")))), corner)
    return t.drop("a", "b", "c")


@C.add("pp pg", """k AS (SELECT s_suppkey AS id, 40*(s_suppkey%8) AS x, 40*(s_suppkey//8) AS y FROM supplier), v AS (SELECT *, x+(id*7)%5-2 AS mx, y+(id*11)%7-3 AS my FROM k),
 t AS (SELECT 2*s.id+i AS tri, a.x AS xa,a.y AS ya,a.mx AS ux,a.my AS uy, b.x AS xb,b.y AS yb,b.mx AS wx,b.my AS wy, c.x AS xc,c.y AS yc,c.mx AS zx,c.my AS zy
   FROM v s CROSS JOIN range(2) r(i) JOIN v a ON a.id=s.id+9*i JOIN v b ON b.id=s.id+1 JOIN v c ON c.id=s.id+8 WHERE s.id%8<7),
 h AS (SELECT pid,qx,qy,gx,gy,t.*, (xb-xa)*(gy-ya)-(yb-ya)*(gx-xa) AS e1, (xc-xb)*(gy-yb)-(yc-yb)*(gx-xb) AS e2, (xa-xc)*(gy-yc)-(ya-yc)*(gx-xc) AS e3, (xb-xa)*(yc-ya)-(yb-ya)*(xc-xa) AS area FROM pg, t),
 f AS (SELECT *, row_number() OVER (PARTITION BY pid,qx,qy ORDER BY tri) AS n FROM h WHERE area<>0 AND ((e1>=0 AND e2>=0 AND e3>=0) OR (e1<=0 AND e2<=0 AND e3<=0))),
 o AS (SELECT *, ((gx-xa)*(yc-ya)-(gy-ya)*(xc-xa))/area::DOUBLE AS k, ((xb-xa)*(gy-ya)-(yb-ya)*(gx-xa))/area::DOUBLE AS l FROM f WHERE n=1);;
 SELECT pg.pid,pg.qx,pg.qy, o.tri, round(ux+k*(wx-ux)+l*(zx-ux),6) AS u, round(uy+k*(wy-uy)+l*(zy-uy),6) AS v FROM pg LEFT JOIN o ON o.pid=pg.pid AND o.qx=pg.qx AND o.qy=pg.qy""")
def cage_deformation(spark, d):
    """All mesh points moved with the first cage triangle that holds them; null outside the cage."""
    out = cage.deform(V.placed_points(spark, d), ["pid", "qx", "qy"], cage_triangles(spark, d), CELL // 2, "gx", "gy")
    return out.select("pid", "qx", "qy", "tri", R("u").alias("u"), R("v").alias("v"))


GROW = BOTH + """, e AS (SELECT s, t, least(s,t) AS p, greatest(s,t) AS q FROM (SELECT DISTINCT s,t FROM b)),
 nb AS (SELECT s, list({'h': (p*7919+q*104729+p*q*31)%1000003, 'p': p, 'q': q, 'd': t, 's': s}) AS n FROM e GROUP BY s),
 cc(id,c) AS (SELECT s,s FROM b UNION SELECT b.t,cc.c FROM cc JOIN b ON b.s=cc.id WHERE cc.c<b.t), root AS (SELECT DISTINCT m AS c FROM (SELECT id, min(c) AS m FROM cc GROUP BY id)),
 v(c,ord,id,parent,seen,open) AS (SELECT c, 1::BIGINT, c, NULL::BIGINT, [c], nb.n FROM root JOIN nb ON nb.s=c
  UNION ALL SELECT c, ord+1, m.d, m.s, list_append(seen, m.d), list_filter(list_concat(open, nb.n), lambda x: x.d<>m.d AND NOT list_contains(seen, x.d)) FROM (SELECT *, list_min(open) AS m FROM v WHERE len(open)>0) JOIN nb ON nb.s=m.d)"""


@C.add("edge", GROW + ";; SELECT c AS component, ord, id, parent FROM v")
def connected_order(spark, d):
    """A random connected order of each component, each patch after the one it hangs on, by the least draws."""
    return spanning.growth_order(V.edges(spark, d))


@C.add("rel", """f AS (SELECT p1 AS s,p2 AS t,0 AS o,a,b,c,d,e,f FROM rel WHERE p1<>p2 UNION ALL SELECT p2,p1,1,a,d,-(a*c+d*f),b,e,-(b*c+e*f) FROM rel WHERE p1<>p2),
 g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s,t ORDER BY o) AS n FROM f) WHERE n=1 AND s%10<>3 AND t%10<>3),
 nb AS (SELECT s, list({'t': t, 'a': a, 'b': b, 'c': c, 'd': d, 'e': e, 'f': f}) AS n FROM g GROUP BY s),
 w(walk,step,id,met,a,b,c,d,e,f) AS (SELECT DISTINCT id, 0, id, [id], 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM (SELECT p1 AS id FROM rel UNION SELECT p2 FROM rel)
  UNION ALL SELECT walk, step+1, m.x.t, list_append(met, m.x.t), a*m.x.a+b*m.x.d, a*m.x.b+b*m.x.e, a*m.x.c+b*m.x.f+c, d*m.x.a+e*m.x.d, d*m.x.b+e*m.x.e, d*m.x.c+e*m.x.f+f
   FROM (SELECT w.*, list_min(list_transform(list_filter(n, lambda x: NOT list_contains(met, x.t)), lambda x: {'h': (walk*7919+x.t*104729+(step+1)*1299709)%1000003, 'k': x.t, 'x': x})) AS m FROM w JOIN nb ON nb.s=w.id WHERE step<7) WHERE m IS NOT NULL);;
 SELECT walk, step, id, round(c,6)+0 AS x, round(f,6)+0 AS y, round(atan2(d,a),6)+0 AS angle FROM w""")
def walk_without_revisits(spark, d):
    """From every patch a walk of up to eight patches that meets none twice and no bad one, with their places."""
    r = V.relations(spark, d)
    ids = r.select(F.col("p1").alias("id")).union(r.select("p2")).distinct()
    w = walks.self_avoiding_walks(r, ids, 8, ids.where("id % 10 = 3"))
    x, y, t = g.placement(g.cols("a b c d e f"))
    return w.select("walk", "step", "id", (R(x) + F.lit(0)).alias("x"), (R(y) + F.lit(0)).alias("y"), (R(t) + F.lit(0)).alias("angle"))


RENDER = NORMAL + """, pn AS (SELECT pp.*, coalesce(x/l,0) AS nx, coalesce(y/l,0) AS ny, coalesce(z/l,0) AS nz FROM pp LEFT JOIN m USING (pid,qx,qy)),
 r AS (SELECT * FROM rel WHERE p1<>p2), w2 AS (SELECT p2 AS v0, p1 AS v1, NULL::BIGINT AS v2, p1 AS last, a,b,c,d,e,f FROM r),
 w3 AS (SELECT m.p2 AS v0, m.p1 AS v1, n.p1 AS v2, n.p1 AS last, m.a*n.a+m.b*n.d AS a, m.a*n.b+m.b*n.e AS b, m.a*n.c+m.b*n.f+m.c AS c, m.d*n.a+m.e*n.d AS d, m.d*n.b+m.e*n.e AS e, m.d*n.c+m.e*n.f+m.f AS f FROM r m JOIN r n ON n.p2=m.p1),
 k AS (SELECT * FROM w2 UNION ALL SELECT * FROM w3), u AS (SELECT v0,v1,v2, a*qx+b*qy+c AS x, d*qx+e*qy+f AS y, vx,vy,vz,nx,ny,nz FROM k JOIN pn ON pid=last),
 s AS (SELECT *, CAST(trunc(x) AS BIGINT)+CASE WHEN x-trunc(x)<0.5 THEN 0 ELSE 1 END AS px, CAST(trunc(y) AS BIGINT)+CASE WHEN y-trunc(y)<0.5 THEN 0 ELSE 1 END AS py FROM u)"""


@C.add("rel pp", RENDER + """;; SELECT v0,v1,v2,count(*) AS cells, round(max(greatest(abs((p.vx-s.vx)*p.nx+(p.vy-s.vy)*p.ny+(p.vz-s.vz)*p.nz), abs((p.vx-s.vx)*s.nx+(p.vy-s.vy)*s.ny+(p.vz-s.vz)*s.nz))),5) AS worst
 FROM s JOIN pn p ON p.pid=v0 AND p.qx=px AND p.qy=py GROUP BY 1,2,3""")
def rendered_walks(spark, d):
    """Walks of two and three patches: the greatest distance along the normals where the last lies on the first."""
    w = walks.rendered_walks(V.relations(spark, d), V.patch_points(spark, d), (2, 3))
    return w.select("v0", "v1", "v2", "cells", R("worst", 5).alias("worst"))


@C.add()
def bad_patch_search(spark, d):
    """Patches removed over walks of two to five, each length without what was removed before."""
    found, _ = walks.bad_patches(V.relations(spark, d), V.patch_points(spark, d))
    return found


@C.add("edge", BOTH + """, e AS (SELECT s,t,min(w) AS w FROM b GROUP BY 1,2), r(id,cost,hops,root) AS (SELECT DISTINCT p1//25*25, 0::BIGINT, 0, p1//25*25 FROM edge UNION SELECT e.t, r.cost+e.w, hops+1, root FROM r JOIN e ON e.s=r.id WHERE r.cost+e.w<=60 AND hops<30),
 k AS (SELECT id, min((cost,hops)) AS m FROM r GROUP BY id), n AS (SELECT id, m[1] AS cost, m[2] AS hops FROM k), p AS (SELECT n.id, min(q.id) AS prev FROM n JOIN e ON e.t=n.id JOIN n q ON q.id=e.s AND q.cost+e.w=n.cost AND q.hops+1=n.hops GROUP BY 1),
 l(id,cur,path) AS (SELECT id, id, [id] FROM n UNION ALL SELECT l.id, p.prev, list_prepend(p.prev, path) FROM l JOIN p ON p.id=l.cur);;
 SELECT n.id, n.cost::DOUBLE AS cost, n.hops::INT AS hops, array_to_string(path,',') AS path FROM n JOIN l ON l.id=n.id AND len(path)=n.hops+1""".replace("min((cost,hops))", "min({'c': cost, 'h': hops})").replace("m[1]", "m.c").replace("m[2]", "m.h"))
def shortest_path_list(spark, d):
    """The cheapest path from the first patch of each block to every patch, with cost and hops, whatever they cost."""
    e = V.edges(spark, d).where("p1 <> p2")
    best = G.saved(G.shortest_paths(e, V.edges(spark, d).select((g.div(F.col("p1"), 25) * 25).alias("id")).distinct()))
    return best.join(walks.paths(best), "id").select("id", "cost", "hops", F.array_join("path", ",").alias("path"))


@C.add("edge", BOTH + """, e AS (SELECT DISTINCT s,t FROM b), k AS (SELECT DISTINCT s AS id, 10.0::DOUBLE*(s%32) AS x, 10.0::DOUBLE*(s//32) AS y, 10+s%7 AS r FROM e),
 j AS (SELECT i.s AS c, i.t AS a, o.t AS b FROM e i JOIN e o ON o.s=i.s AND o.t>i.t JOIN k kc ON kc.id=i.s JOIN k ka ON ka.id=i.t JOIN k kb ON kb.id=o.t WHERE sqrt((ka.x-kb.x)*(ka.x-kb.x)+(ka.y-kb.y)*(ka.y-kb.y))>2.0*kc.r+ka.r+kb.r),
 s(open,id,n) AS (SELECT list({'c': c, 'a': a, 'b': b}), NULL::BIGINT, 0 FROM j
  UNION ALL SELECT list_filter(open, lambda t: t.c<>m.x AND t.a<>m.x AND t.b<>m.x), m.x, -m.n FROM (SELECT open, list_min(list_transform(list_distinct(list_transform(open, lambda t: t.c)), lambda x: {'n': -len(list_filter(open, lambda t: t.c=x)), 'x': x})) AS m FROM s WHERE len(open)>0));;
 SELECT id, n::BIGINT AS n FROM s WHERE id IS NOT NULL""")
def bad_bridges(spark, d):
    """Patches that join others which lie too far apart to be its neighbours, removed by most such pairs first."""
    near = G.undirected(V.edges(spark, d))
    places = near.select(F.col("src").alias("id")).distinct().select("id", (F.col("id") % 32 * 10.0).alias("x"), (g.div(F.col("id"), 32) * 10.0).alias("y"), (10 + F.col("id") % 7).alias("radius"))
    return walks.bad_bridges(walks.implausible_bridges(near, places)).select("id", "n")


@C.add("edge", VISIT + """, m AS (SELECT min(c) AS c FROM root), o AS (SELECT v.ord, v.id FROM v JOIN m ON v.c=m.c);;
 SELECT h.id AS p, l.id AS other, 1::BIGINT AS mismatch, h.ord AS ord FROM o h JOIN o l ON l.ord<h.ord JOIN (SELECT DISTINCT p1,p2 FROM edge) e ON e.p1=h.id AND e.p2=l.id""")
def visit_files(spark, d):
    """The visit order of the first component as a file of patches, and the relations to patches visited before as lines patch,other,1; both read again."""
    e, order = V.edges(spark, d), G.saved(G.visit_order(V.edges(spark, d)))
    first = order.join(order.agg(F.min("component").alias("component")), "component").select("ord", "id")
    orders, near = new_folder(spark, "patchorder"), new_folder(spark, "neighbours")
    T.write_fields(first.orderBy("ord"), orders)
    here, before = first.select(F.col("id").alias("p1"), "ord"), first.select(F.col("id").alias("p2"), F.col("ord").alias("earlier"))
    T.write_fields(e.join(here, "p1").join(before, "p2").where("earlier < ord").orderBy("ord").select("p1", "p2", F.lit(1)), near)
    back = T.fields(spark.read.text(near), ["p", "other", "mismatch"]).select(*(F.col(c).cast("long").alias(c) for c in ("p", "other", "mismatch")))
    place = T.fields(spark.read.text(orders), ["ord", "p"]).select(*(F.col(c).cast("long").alias(c) for c in ("ord", "p")))
    return back.join(place, "p").select("p", "other", "mismatch", "ord")
