"""Sinks and sources: each query writes a table in a file format and returns what its reader gives back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import graph as G
from lamina.plans.aggregates import pair_scores
from lamina.plans.catalog import Catalog
from lamina.plans.graphs import VISIT
from lamina.sources import patch_files, text_tables as T, views as V
from lamina.sources.scratch import new_folder

C = Catalog()
R = lambda c, n=6: F.round(c, n)
CHUNK = 64


@C.add("pp", "SELECT pid, qx, qy, vx::DOUBLE AS vx, vy::DOUBLE AS vy, vz::DOUBLE AS vz FROM pp")
def patch_file_scan(spark, d):
    """Binary patch files, written and read whole."""
    folder = new_folder(spark, "patches")
    patch_files.write_patches(V.patch_points(spark, d), folder).agg(F.sum("points")).collect()
    patch_files.register(spark)
    return spark.read.format("patches").load(folder).select("pid", *(F.col(c).cast("long").alias(c) for c in ("qx", "qy")), "vx", "vy", "vz")


@C.add("edge pp", "SELECT pid, count(*) AS n, sum(vz)::DOUBLE AS z FROM pp WHERE pid IN (SELECT p2 FROM edge WHERE w>=8) GROUP BY pid")
def patch_file_subset(spark, d):
    """Points of the patches on a list, from a folder of patch files."""
    folder = new_folder(spark, "patches")
    patch_files.write_patches(V.patch_points(spark, d), folder).agg(F.sum("points")).collect()
    patch_files.register(spark)
    ids = V.edges(spark, d).where("w >= 8").select(F.col("p2").alias("pid")).distinct()
    return spark.read.format("patches").load(folder).join(ids, "pid", "left_semi").groupBy("pid").agg(F.count("*").alias("n"), F.sum("vz").alias("z"))


@C.add("rel", "SELECT p1,p2," + ",".join(f"round({e},6)+0 AS {n}" for e, n in zip(("v0", "w::DOUBLE", "v2", "w/3", "0.0::DOUBLE", "1.0::DOUBLE", *"abcdef"), T.RELATION[2:], strict=True)) + " FROM rel")
def relation_file(spark, d):
    """Relations as lines of fourteen numbers."""
    r, folder = V.relations(spark, d), new_folder(spark, "relations")
    T.write_fields(r.select("p1", "p2", "v0", F.col("w").alias("v1"), "v2", (F.col("w") / 3).alias("v3"), F.lit(0).alias("v4"), F.lit(1).alias("v5"), *"abcdef"), folder)
    return T.relations(spark, folder).select("p1", "p2", *((R(c) + F.lit(0)).alias(c) for c in T.RELATION[2:]))


@C.add("edge", "SELECT p1,p2,w::DOUBLE AS w FROM edge")
def edge_file(spark, d):
    """Weighted edges under a header line, which the reader leaves out."""
    folder = new_folder(spark, "edges")
    T.write_fields(V.edges(spark, d).select("p1", "p2", "w"), folder, header=True)
    return T.weighted_edges(spark, folder)


@C.add("edge pp", "SELECT DISTINCT p1 AS id FROM edge WHERE w>9 UNION SELECT pid FROM pp WHERE pid%7=3")
def id_list_files(spark, d):
    """The union of two lists of bad patches."""
    one, two = (new_folder(spark, "ids") for _ in range(2))
    T.write_fields(V.edges(spark, d).where("w > 9").select("p1"), one)
    T.write_fields(V.patch_points(spark, d).where("pid % 7 = 3").select("pid").distinct(), two)
    return T.id_lists(spark, one, two)


@C.add("pg", """SELECT l.pid AS a, r.pid AS b, round(max(sqrt(((l.vx-r.vx)*(l.vx-r.vx)+(l.vy-r.vy)*(l.vy-r.vy)+(l.vz-r.vz)*(l.vz-r.vz))::DOUBLE)),6) AS score
 FROM pg l JOIN pg r ON l.gx=r.gx AND l.gy=r.gy AND l.pid<r.pid GROUP BY 1,2""")
def bad_score_file(spark, d):
    """Scores of overlapping patches as a file of three fields."""
    folder = new_folder(spark, "scores")
    T.write_fields(pair_scores(V.placed_points(spark, d)).select("a", "b", "worst"), folder)
    return T.fields(spark.read.text(folder), ["a", "b", "score"]).select(*(F.col(c).cast("long").alias(c) for c in "ab"), "score")


@C.add("pp", "SELECT DISTINCT pid, 10.0::DOUBLE*(pid%32) AS x, 10.0::DOUBLE*(pid//32) AS y, (pid%7)/8 AS angle FROM pp")
def placement_file(spark, d):
    """Placements as lines of four numbers between spaces."""
    p, folder = V.patch_points(spark, d).select("pid").distinct(), new_folder(spark, "placements")
    T.write_fields(p.select("pid", (F.col("pid") % V.COLUMNS * 10.0).alias("x"), (g.div(F.col("pid"), V.COLUMNS) * 10.0).alias("y"), (F.col("pid") % 7 / 8).alias("angle")), folder, " ")
    return T.placements(spark, folder)


@C.add("pp", "SELECT pid, vx::DOUBLE AS x, vy::DOUBLE AS y, vz::DOUBLE AS z FROM pp WHERE qx=0 AND qy=0")
def centre_file(spark, d):
    """Patch centres as lines of exactly four fields."""
    folder = new_folder(spark, "centres")
    T.write_fields(V.patch_points(spark, d).where("qx = 0 and qy = 0").select("pid", "vx", "vy", "vz"), folder)
    return T.fields(spark.read.text(folder), ["pid", "x", "y", "z"]).withColumn("pid", F.col("pid").cast("long"))


@C.add("rel", VISIT + ";; SELECT h.ord, rel.p1 AS p, rel.p2 AS other, round(rel.a,6)+0 AS a, round(rel.c,6)+0 AS c FROM rel JOIN v h ON h.id=p1 JOIN v l ON l.id=p2 WHERE l.ord<h.ord")
def alignment_order_file(spark, d):
    """The relations of each patch to those visited before it, in visit order, as lines of numbers between spaces; read back with both ends and parts of the transform."""
    order, r, folder = G.visit_order(V.edges(spark, d)), V.relations(spark, d), new_folder(spark, "alignments")
    here = order.select(F.col("id").alias("p1"), "ord")
    before = order.select(F.col("id").alias("p2"), F.col("ord").alias("earlier"))
    rows = r.join(here, "p1").join(before, "p2").where("earlier < ord").select("ord", "p1", F.lit(20).alias("radius"), "p2", *"abcdef")
    T.write_fields(rows, folder, " ")
    back = T.fields(spark.read.text(folder), ["ord", "p", "radius", "other", *"abcdef"], r"\s+")
    return back.select(*(F.col(c).cast("long").alias(c) for c in ("ord", "p", "other")), *((R(c) + F.lit(0)).alias(c) for c in "ac"))


@C.add("surf", "SELECT x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, count(*) AS sets FROM surf GROUP BY ALL")
def point_file(spark, d):
    """Surface points as lines x,y,z, and how many sets hold each."""
    folder = new_folder(spark, "points")
    T.write_fields(V.point_sets(spark, d).select("x", "y", "z"), folder)
    return T.points(spark, folder).groupBy("x", "y", "z").agg(F.count("*").alias("sets"))


@C.add("pp", "SELECT qx::DOUBLE AS qx, qy::DOUBLE AS qy, vx::DOUBLE AS vx, vy::DOUBLE AS vy, vz::DOUBLE AS vz FROM pp")
def mesh_file(spark, d):
    """Mesh points in one folder, some lines with commas and some with spaces, and lines of other kinds that are left out."""
    p, folder = V.patch_points(spark, d), new_folder(spark, "mesh")
    for rest, sep in ((0, ","), (1, " ")):
        T.write_fields(p.where(F.col("pid") % 2 == rest).select("qx", "qy", "vx", "vy", "vz"), folder, sep)
    T.write_fields(p.select("pid").distinct(), folder, tag="patch")
    return T.mesh_points(spark, folder)


REGIONS = "b AS (SELECT file,min(x) AS x0,min(y) AS y0,min(z) AS z0,max(x) AS x1,max(y) AS y1,max(z) AS z1 FROM surf GROUP BY file HAVING count(*)>100)"


@C.add("surf", REGIONS + ";; SELECT x0-1 AS xmin,y0-1 AS ymin,z0-1 AS zmin,x1+1 AS xmax,y1+1 AS ymax,z1+1 AS zmax FROM b")
def extent_file(spark, d):
    """Extents of large regions, read back grown by one on each side."""
    ends = [f(a).alias(f"{a}{k}") for k, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    folder = new_folder(spark, "extents")
    T.write_fields(V.point_sets(spark, d).groupBy("file").agg(*ends, F.count("*").alias("n")).where("n > 100").drop("file", "n"), folder)
    return T.extents(spark, folder, 1)


@C.add("surf", REGIONS + ";; SELECT file, count(*) AS n, min(x)::DOUBLE AS xmin, max(z)::DOUBLE AS zmax FROM surf JOIN b USING (file) GROUP BY file")
def region_files(spark, d):
    """Each large region in files of its own."""
    s, folder = V.point_sets(spark, d), new_folder(spark, "regions")
    large = s.groupBy("file").agg(F.count("*").alias("n")).where("n > 100")
    T.write_runs(s.join(large, "file", "left_semi").select(F.col("file").alias("region"), "x", "y", "z"), folder, "region")
    back = T.run_files(spark, folder, ["x", "y", "z"]).withColumn("file", F.regexp_extract("file", r"region=(-?\d+)", 1).cast("long"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("z").alias("zmax"))


@C.add("sample", "SELECT file, count(*) AS n, min(score)::DOUBLE AS best, max(iter)::DOUBLE AS last FROM sample GROUP BY file")
def run_result_files(spark, d):
    """Result files of many runs, with the run each line came from."""
    folder = new_folder(spark, "runs")
    T.write_runs(V.samples(spark, d).select(F.col("file").alias("run"), "iter", "score"), folder, "run")
    back = T.run_files(spark, folder, ["iter", "score"]).withColumn("file", F.regexp_extract("file", r"run=(-?\d+)", 1).cast("long"))
    return back.groupBy("file").agg(F.count("*").alias("n"), F.min("score").alias("best"), F.max("iter").alias("last"))


@C.add("rel", """SELECT 'ABS' AS kind, p1::DOUBLE AS patch, NULL::DOUBLE AS other, (p1%32)::DOUBLE AS x FROM rel GROUP BY p1 UNION ALL SELECT 'REL', p1, p2, c FROM rel""")
def tagged_log_file(spark, d):
    """One log with absolute and relative records, parted again by their tags."""
    r, folder = V.relations(spark, d), new_folder(spark, "log")
    head = [F.col("p1").alias("patch"), F.lit(0).alias("flip"), F.lit(5).alias("iters")]
    T.write_fields(r.select("p1").distinct().select(*head, (F.col("p1") % V.COLUMNS).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("a")), folder, " ", "ABS")
    T.write_fields(r.select(*head, "p2", *(F.lit(i).alias(f"v{i}") for i in range(6)), *"abcdef"), folder, " ", "REL")
    absolute, relative = T.tagged_log(spark, folder)
    one = absolute.select(F.lit("ABS").alias("kind"), "patch", F.lit(None).cast("double").alias("other"), "x")
    return one.union(relative.select(F.lit("REL"), "patch", "other", "t2"))


@C.add("pp", "SELECT printf('v %f %f %f', vx::DOUBLE, vy::DOUBLE, vz::DOUBLE) AS line, count(*) AS n FROM pp GROUP BY 1")
def vertex_file(spark, d):
    """Vertices as lines of a mesh file."""
    folder = new_folder(spark, "vertices")
    T.write_lines(V.patch_points(spark, d).select(*(F.col(f"v{a}").cast("double").alias(a) for a in "xyz")), folder, "v %f %f %f", "x", "y", "z")
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


KEYS = ", ".join(f"CAST(floor(v{a}/{CHUNK}.0) AS INT) AS c{a}" for a in "xyz")


def _store(spark, d):
    folder = new_folder(spark, "chunks")
    T.write_chunks(V.patch_points(spark, d), folder, CHUNK)
    return folder


@C.add("pp", f"SELECT DISTINCT {KEYS} FROM pp")
def chunk_list(spark, d):
    return T.list_chunks(spark, _store(spark, d))


@C.add("pp", f"""k AS (SELECT *, {KEYS} FROM pp), n AS (SELECT DISTINCT cx+a AS cx, cy+b AS cy, cz+c AS cz FROM (SELECT DISTINCT cx,cy,cz FROM k WHERE pid%16=5), range(-1,2) x(a), range(-1,2) y(b), range(-1,2) z(c));;
 SELECT cx,cy,cz,count(*) AS n,sum(vz)::BIGINT AS z FROM k SEMI JOIN n USING (cx,cy,cz) GROUP BY ALL""")
def chunk_neighbourhood(spark, d):
    """The chunks of every sixteenth patch and those around them, from a store of chunks."""
    folder = _store(spark, d)
    asked = V.patch_points(spark, d).where("pid % 16 = 5").select(*(F.floor(F.col(f"v{a}") / CHUNK).cast("int").alias(f"c{a}") for a in "xyz")).distinct()
    return T.read_chunks(spark, folder, asked).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.sum("vz").alias("z"))


@C.add("pp", f"SELECT {KEYS}, count(*) AS n FROM pp WHERE pid%7<>3 GROUP BY 1,2,3")
def chunk_rewrite(spark, d):
    """The chunks of bad patches, rewritten without them or deleted where nothing is left; other chunks stay as they were."""
    folder, p = _store(spark, d), V.patch_points(spark, d)
    key = lambda df: df.select(*(F.floor(F.col(f"v{a}") / CHUNK).cast("int").alias(f"c{a}") for a in "xyz")).distinct()
    keyed = p.withColumns({f"c{a}": F.floor(F.col(f"v{a}") / CHUNK).cast("int") for a in "xyz"})
    bad = key(p.where("pid % 7 = 3"))
    T.rewrite_chunks(keyed.join(bad, ["cx", "cy", "cz"], "left_semi").where("pid % 7 <> 3").drop("cx", "cy", "cz"), folder, CHUNK, bad)
    return T.read_chunks(spark, folder).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


@C.add("pp", """s AS (SELECT DISTINCT vx+a AS x, vy+b AS y, vz+c AS z FROM (SELECT vx,vy,vz FROM pp WHERE pid%7<>3), range(-1,2) p(a), range(-1,2) q(b), range(-1,2) r(c));;
 SELECT CAST(floor(x/16) AS BIGINT) AS cx, CAST(floor(y/16) AS BIGINT) AS cy, z, count(*) AS voxels FROM s GROUP BY 1,2,3""")
def surface_stamp(spark, d):
    """Voxels within one step of a point of a patch that is not bad, by block and slice: an anti-join with the bad list, then each point's 27 voxels once."""
    p = V.patch_points(spark, d)
    good = p.join(p.where("pid % 7 = 3").select("pid").distinct(), "pid", "left_anti")
    span = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    s = good.select("vx", "vy", "vz").distinct()
    for a in "xyz":
        s = s.withColumn("_o", F.explode(span)).withColumn(a, F.col(f"v{a}") + F.col("_o")).drop(f"v{a}", "_o").distinct()
    return s.groupBy(g.cell(F.col("x"), 16).alias("cx"), g.cell(F.col("y"), 16).alias("cy"), "z").agg(F.count("*").alias("voxels"))


@C.add("pp", """e AS (SELECT pid, min(qx) AS x0, max(qx) AS x1, min(qy) AS y0, max(qy) AS y1 FROM pp GROUP BY pid),
 t AS (SELECT pid, qx, unnest(generate_series(y0, y1)) AS qy FROM (SELECT pid, y0, y1, unnest(generate_series(x0, x1)) AS qx FROM e));;
 SELECT t.pid, t.qx, t.qy, coalesce(vx,-1) AS vx, coalesce(vy,-1) AS vy, coalesce(vz,-1) AS vz FROM t LEFT JOIN pp USING (pid,qx,qy)""")
def raster_export(spark, d):
    """Each patch as a full raster over its extent, with -1 at holes."""
    p = V.patch_points(spark, d)
    e = p.groupBy("pid").agg(*(f(c).alias(f"{c}_{k}") for c in ("qx", "qy") for k, f in (("0", F.min), ("1", F.max))))
    cells = e.select("pid", F.explode(F.sequence("qx_0", "qx_1")).alias("qx"), "qy_0", "qy_1").select("pid", "qx", F.explode(F.sequence("qy_0", "qy_1")).alias("qy"))
    return cells.join(p, ["pid", "qx", "qy"], "left").select("pid", "qx", "qy", *(F.coalesce(f"v{a}", F.lit(-1)).cast("long").alias(f"v{a}") for a in "xyz"))
