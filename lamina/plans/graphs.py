"""Graph queries and iterative solvers over the relations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import graph as G
from lamina.operators import relax
from lamina.operators.ends import compared_ends
from lamina.operators.walks import hitting_set as hitting_set_of
from lamina.plans.aggregates import pair_scores
from lamina.plans.catalog import Catalog
from lamina.sources import views as V

C = Catalog()
R = lambda c, n=6: F.round(c, n)
BOTH = "b AS (SELECT p1 AS s, p2 AS t, w FROM edge WHERE p1<>p2 UNION SELECT p2, p1, w FROM edge WHERE p1<>p2)"
BAD = 10


@C.add("edge", """n AS (SELECT p1,p2 FROM edge WHERE p1%10<>3 AND p2%10<>3 AND w<10 AND p1<>p2);; SELECT p1 AS src, p2 AS dst FROM n UNION SELECT p2,p1 FROM n""")
def neighbour_list(spark, d):
    """Neighbours both ways, without bad vertices and bad relations."""
    e = V.edges(spark, d).where("p1 % 10 <> 3 and p2 % 10 <> 3 and w < 10")
    return G.undirected(e)


@C.add("edge", """r(id,c) AS (SELECT s,s FROM b UNION SELECT b.t,r.c FROM r JOIN b ON b.s=r.id WHERE r.c<b.t), l AS (SELECT id,min(c) AS c FROM r GROUP BY id);; SELECT c AS component, count(*) AS size FROM l GROUP BY c""".replace("r(id,c)", BOTH + ", r(id,c)"))
def component_sizes(spark, d):
    return G.components(V.edges(spark, d)).groupBy("component").agg(F.count("*").alias("size"))


@C.add("edge", BOTH + """, h(id,hop) AS (SELECT DISTINCT s,0 FROM b WHERE s%25 IN (0,7) UNION SELECT b.t,hop+1 FROM h JOIN b ON b.s=h.id WHERE hop<2), k AS (SELECT id,min(hop) AS hop FROM h GROUP BY id);;
 SELECT p1,p2,w,CAST(a.hop AS INT) AS hop1,CAST(c.hop AS INT) AS hop2 FROM edge JOIN k a ON a.id=p1 JOIN k c ON c.id=p2""")
def bfs_subgraph(spark, d):
    """Relations among vertices at most two hops from the seeds."""
    e = V.edges(spark, d)
    k = G.within_hops(e, e.select(F.col("p1").alias("id")).union(e.select("p2")).where("id % 25 in (0, 7)"), 2)
    a, b = (k.select(F.col("id").alias(p), F.col("hop").alias(h)) for p, h in (("p1", "hop1"), ("p2", "hop2")))
    return e.join(a, "p1").join(b, "p2").select("p1", "p2", "w", "hop1", "hop2")


@C.add("edge", """e AS (SELECT DISTINCT p1,p2 FROM edge WHERE p1%10<>3 AND p2%10<>3);; SELECT a.p1 AS v0, b.p1 AS v1, c.p1 AS v2, c.p2 AS v3 FROM e a JOIN e b ON a.p2=b.p1 JOIN e c ON b.p2=c.p1""")
def walks_of_four(spark, d):
    e = V.edges(spark, d)
    banned = e.select(F.col("p1").alias("id")).union(e.select("p2")).where("id % 10 = 3").distinct()
    return G.walks(e, 4, banned)


@C.add("rel", """SELECT m.p1 AS v0, m.p2 AS v1, n.p2 AS v2, round(m.a*n.c+m.b*n.f+m.c,6)+0 AS x, round(m.d*n.c+m.e*n.f+m.f,6)+0 AS y, round(sqrt(pow(m.a*n.c+m.b*n.f+m.c,2)+pow(m.d*n.c+m.e*n.f+m.f,2)),6) AS far FROM rel m JOIN rel n ON m.p2=n.p1""")
def walk_transform(spark, d):
    """Where the end of each walk of three vertices lies in the frame of its start."""
    r = V.relations(spark, d)
    m, n = r.alias("m"), r.alias("n")
    out = g.compose(g.cols("a b c d e f", "m."), g.cols("a b c d e f", "n."))
    x, y = out[2], out[5]
    return m.join(n, F.col("m.p2") == F.col("n.p1")).select(F.col("m.p1").alias("v0"), F.col("m.p2").alias("v1"), F.col("n.p2").alias("v2"), (R(x) + F.lit(0)).alias("x"), (R(y) + F.lit(0)).alias("y"), R(g.length([x, y])).alias("far"))


@C.add("edge", "SELECT p AS id, count(*) AS degree, min(q) AS least, max(q) AS most FROM (SELECT p1 AS p,p2 AS q FROM edge WHERE p1<>p2 UNION SELECT p2,p1 FROM edge WHERE p1<>p2) GROUP BY p")
def vertex_degree(spark, d):
    return G.undirected(V.edges(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.min("dst").alias("least"), F.max("dst").alias("most"))


@C.add("rel", "SELECT p1,p2,round(c,6) AS x,round(f,6) AS y,round(atan2(d,a),6)+0 AS angle FROM rel WHERE p1<p2 AND p1%10<>3 AND p2%10<>3")
def adjacent_pairs(spark, d):
    """Adjacent pairs of an id range, without bad patches, with their relative placement."""
    x, y, t = g.placement(g.cols("a b c d e f"))
    return V.relations(spark, d).where("p1 < p2 and p1 % 10 <> 3 and p2 % 10 <> 3").select("p1", "p2", R(x).alias("x"), R(y).alias("y"), (R(t) + F.lit(0)).alias("angle"))


@C.add("edge", BOTH + """, e AS (SELECT s,t,min(w) AS w FROM b WHERE w<=8 GROUP BY 1,2), r(id,cost) AS (SELECT DISTINCT p1//25*25, 0::BIGINT FROM edge UNION SELECT e.t, r.cost+e.w FROM r JOIN e ON e.s=r.id WHERE r.cost+e.w<=40);;
 SELECT id, min(cost)::DOUBLE AS cost FROM r GROUP BY id HAVING min(cost)<=30""")
def shortest_costs(spark, d):
    """Least cost from the first vertex of each block over relations of weight 8 at most."""
    e = V.edges(spark, d).where("p1 <> p2")
    roots = e.select((g.div(F.col("p1"), 25) * 25).alias("id")).distinct()
    return G.shortest_paths(e, roots, 8).where("cost <= 30").select("id", "cost")


VISIT = BOTH + """, nb AS (SELECT s, list(DISTINCT t) AS n FROM b GROUP BY s), cc(id,c) AS (SELECT s,s FROM b UNION SELECT b.t,cc.c FROM cc JOIN b ON b.s=cc.id WHERE cc.c<b.t),
 root AS (SELECT DISTINCT m AS c FROM (SELECT id, min(c) AS m FROM cc GROUP BY id)),
 v(c,ord,id,seen,open) AS (SELECT c, 1::BIGINT, c, [c], nb.n FROM root JOIN nb ON nb.s=c
  UNION ALL SELECT c, ord+1, nb.s, list_append(seen, nb.s), list_distinct(list_filter(list_concat(open, nb.n), lambda x: x<>nb.s AND NOT list_contains(seen, x))) FROM v JOIN nb ON nb.s=list_min(open) WHERE len(open)>0)"""


@C.add("edge", VISIT + ";; SELECT c AS component, ord, id FROM v")
def visit_order(spark, d):
    """Each component's patches, always the least one next to what was visited."""
    return G.visit_order(V.edges(spark, d))


def walk_scores(relations, points, vertices: int):
    """(v0, ..., cells, worst): for each walk, the greatest distance between its first and last patch where they share lattice places.

    Transforms are composed along the walk; the last patch's mesh points are rounded to places in the first one's frame.
    """
    steps = relations.select("p1", "p2", *"abcdef")
    walk = steps.select(F.col("p1").alias("v0"), F.col("p2").alias("v1"), *"abcdef")
    for k in range(2, vertices):
        more = steps.select(F.col("p1").alias(f"v{k - 1}"), F.col("p2").alias(f"v{k}"), *(F.col(c).alias(f"n{c}") for c in "abcdef"))
        walk = walk.join(more, f"v{k - 1}")
        both = g.compose(g.cols("a b c d e f"), g.cols("na nb nc nd ne nf"))
        walk = walk.select(*(f"v{i}" for i in range(k + 1)), *(c.alias(n) for n, c in zip("abcdef", both, strict=True)))
    names = [f"v{i}" for i in range(vertices)]
    walk = walk.select(F.col("v0").alias("first"), F.col(names[-1]).alias("last"), *names, *"abcdef")
    return compared_ends(walk, points, names, False).withColumn("worst", R("worst"))


@C.add("rel pp", """k AS (SELECT m.p1 AS v0, m.p2 AS v1, n.p2 AS v2, m.a*n.a+m.b*n.d AS a, m.a*n.b+m.b*n.e AS b, m.a*n.c+m.b*n.f+m.c AS c, m.d*n.a+m.e*n.d AS d, m.d*n.b+m.e*n.e AS e, m.d*n.c+m.e*n.f+m.f AS f FROM rel m JOIN rel n ON m.p2=n.p1),
 t AS (SELECT v0,v1,v2, a*qx+b*qy+c AS x, d*qx+e*qy+f AS y, vx,vy,vz FROM k JOIN pp ON pid=v2),
 l AS (SELECT *, CAST(trunc(x) AS BIGINT)+CASE WHEN x-trunc(x)<0.5 THEN 0 ELSE 1 END AS px, CAST(trunc(y) AS BIGINT)+CASE WHEN y-trunc(y)<0.5 THEN 0 ELSE 1 END AS py FROM t),
 s AS (SELECT v0,v1,v2,count(*) AS cells, round(max(sqrt(((l.vx-p.vx)*(l.vx-p.vx)+(l.vy-p.vy)*(l.vy-p.vy)+(l.vz-p.vz)*(l.vz-p.vz))::DOUBLE)),6) AS worst FROM l JOIN pp p ON p.pid=v0 AND p.qx=px AND p.qy=py GROUP BY 1,2,3);;
 SELECT v0,v1,v2,cells,worst,worst>20 AS bad FROM s""")
def walk_mismatch(spark, d):
    """Walks of three patches whose ends lie further apart than a limit that grows with the walk."""
    return walk_scores(V.relations(spark, d), V.patch_points(spark, d), 3).withColumn("bad", F.col("worst") > BAD * 2)


@C.add("edge", BOTH + ", ok AS (SELECT s FROM b WHERE s%10<>3);; SELECT p1,p2,w FROM edge WHERE w<=8 AND p1 IN (SELECT s FROM ok) AND p2 IN (SELECT s FROM ok)")
def allowed_edges(spark, d):
    """Relations within a weight limit whose ends are both on a list."""
    e = V.edges(spark, d)
    ok = e.select(F.col("p1").alias("id")).union(e.select("p2")).where("id % 10 <> 3").distinct()
    for end in ("p1", "p2"):
        e = e.join(ok.withColumnRenamed("id", end), end, "left_semi")
    return e.where("w <= 8").select("p1", "p2", "w")


@C.add("pg", """l AS (SELECT l.pid AS a, r.pid AS b, max(sqrt(((l.vx-r.vx)*(l.vx-r.vx)+(l.vy-r.vy)*(l.vy-r.vy)+(l.vz-r.vz)*(l.vz-r.vz))::DOUBLE)) AS worst FROM pg l JOIN pg r ON l.gx=r.gx AND l.gy=r.gy AND l.pid<r.pid GROUP BY 1,2),
 s(open,id,round) AS (SELECT list([a,b]), NULL::BIGINT, 0 FROM l WHERE worst>10
  UNION ALL SELECT list_filter(open, lambda t: NOT list_contains(t, m.x)), m.x, round+1 FROM (SELECT *, list_min(list_transform(list_distinct(flatten(open)), lambda x: {'n': -len(list_filter(flatten(open), lambda y: y=x)), 'x': x})) AS m FROM s WHERE len(open)>0));;
 SELECT id, round FROM s WHERE id IS NOT NULL""")
def hitting_set(spark, d):
    """Patches to remove, most frequent first, until no overlapping pair is further apart than the limit. Every planted bad patch is among them."""
    pairs = pair_scores(V.placed_points(spark, d)).where(F.col("worst") > BAD).select("a", "b")
    return hitting_set_of(pairs)


@C.add("pg", """l AS (SELECT l.pid AS a, r.pid AS b, max(sqrt(((l.vx-r.vx)*(l.vx-r.vx)+(l.vy-r.vy)*(l.vy-r.vy)+(l.vz-r.vz)*(l.vz-r.vz))::DOUBLE)) AS worst FROM pg l JOIN pg r ON l.gx=r.gx AND l.gy=r.gy AND l.pid<r.pid GROUP BY 1,2);;
 SELECT p AS pid, count(*) AS bad_pairs FROM (SELECT a AS p FROM l WHERE worst>10 UNION ALL SELECT b FROM l WHERE worst>10) GROUP BY p""")
def mismatch_counts(spark, d):
    """How many overlapping partners each patch disagrees with."""
    bad = pair_scores(V.placed_points(spark, d)).where(F.col("worst") > BAD)
    return bad.select(F.explode(F.array("a", "b")).alias("pid")).groupBy("pid").agg(F.count("*").alias("bad_pairs"))


@C.add("edge", BOTH + """, h(id,hop) AS (SELECT DISTINCT p1//25*25,0 FROM edge UNION SELECT edge.p2,hop+1 FROM h JOIN edge ON edge.p1=h.id WHERE hop<24), k AS (SELECT id,min(hop) AS level FROM h GROUP BY id);; SELECT id AS p, CAST(level AS INT) AS level FROM k""")
def placement_levels(spark, d):
    """The level at which each patch is placed, from the first patch of each block."""
    r = V.relations(spark, d)
    roots = r.select((g.div(F.col("p1"), 25) * 25).alias("id")).distinct()
    return relax.place(r, roots).select("p", "level")


@C.add()
def place_patches(spark, d):
    """Placements of all patches, composed along the relations from each block's first patch."""
    r = V.relations(spark, d)
    placed = relax.place(r, r.select((g.div(F.col("p1"), 25) * 25).alias("id")).distinct())
    x, y, t = g.placement(g.cols("a b c d e f"))
    return placed.select("p", "level", "from_p", R(x).alias("x"), R(y).alias("y"), R(t).alias("angle"))


@C.add()
def spring_relax(spark, d):
    """Placements on a grid after ten steps of springs that ask for twice the distance between linked patches."""
    e = V.edges(spark, d).where("p1 < p2")
    ids = e.select(F.col("p1").alias("pid")).union(e.select("p2")).distinct()
    grid = ids.select("pid", (F.col("pid") % 5 * 10.0).alias("x"), (g.div(F.col("pid"), 5) * 10.0).alias("y"), F.lit(0.0).alias("angle"))
    links = e.select("p1", "p2", F.lit(20.0).alias("dist"), F.lit(0.0).alias("turn1"), F.lit(math.pi).alias("turn2"))
    out = relax.springs(grid, links, 10, 0.01, 0.005)
    return out.select("pid", R("x", 4).alias("x"), R("y", 4).alias("y"), R("angle", 4).alias("angle"))


@C.add()
def anneal_state(spark, d):
    """Patches toggled by a short annealing over the mismatched pairs."""
    p = V.placed_points(spark, d)
    return relax.anneal(p.select("pid").distinct(), pair_scores(p).where(F.col("worst") > BAD), 6)


@C.add("pp", """m AS (SELECT a.pid AS p1, b.pid AS p2, a.qx AS x0, a.qy AS y0, a.qx+10.0*((a.pid%32)-(b.pid%32)) AS gx, a.qy+10.0*((a.pid//32)-(b.pid//32)) AS gy FROM pp a JOIN pp b ON b.pid=a.pid+1 AND b.qx=a.qx AND b.qy=a.qy);;
 SELECT p1,p2,count(*) AS n, round(avg(gx-x0),6) AS dx, round(avg(gy-y0),6) AS dy, round(var_pop(gx-x0),6) AS var_x FROM m GROUP BY 1,2""")
def similarity_fit(spark, d):
    """Translation between neighbouring patches and its variance, from all matched mesh points."""
    p = V.patch_points(spark, d)
    a = p.select((F.col("pid") + 1).alias("p2"), "qx", "qy", F.col("pid").alias("p1"))
    m = a.join(p.select(F.col("pid").alias("p2"), "qx", "qy"), ["p2", "qx", "qy"])
    dx = 10.0 * (F.col("p1") % V.COLUMNS - F.col("p2") % V.COLUMNS)
    dy = 10.0 * (g.div(F.col("p1"), V.COLUMNS) - g.div(F.col("p2"), V.COLUMNS))
    return m.groupBy("p1", "p2").agg(F.count("*").alias("n"), R(F.avg(dx)).alias("dx"), R(F.avg(dy)).alias("dy"), R(F.var_pop(dx)).alias("var_x"))


@C.add("pp", """SELECT pid, qx, qy FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY (qx*7919+qy*104729+pid*1299709)%1000003, qx, qy) AS r FROM pp) WHERE r<=3""")
def pick_seeds(spark, d):
    """Three seed points of each patch by a fixed hash, so that no random state is needed."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy((F.col("qx") * 7919 + F.col("qy") * 104729 + F.col("pid") * 1299709) % 1000003, "qx", "qy"))
    return V.patch_points(spark, d).withColumn("r", rank).where("r <= 3").select("pid", "qx", "qy")
