"""Canonical tables of surface analysis derived from star-schema tables.

Each view exists twice, as a DataFrame and as a DuckDB common table expression (``SQL``), so that a
query and its oracle read the same rows. Patches grow with suppliers, voxels with embeddings, point
sets with customers and logs with events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 32  # patches stand on a grid this wide
SPACING = 10  # mesh steps between neighbouring patches


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def whole(c: Column | str) -> Column:
    """A number as the nearest integer."""
    return F.round(c).cast("long")


def patch_points(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """pp(pid, qx, qy, vx, vy, vz): mesh points; every patch with pid % 7 = 3 stands 15 too high. ``together``: a patch is in one partition."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("pid"), (F.col("l_partkey") % 41 - 20).alias("qx"), (F.col("l_orderkey") % 41 - 20).alias("qy"), "l_discount", "l_tax", "l_quantity"
    )
    li = li.repartition("pid") if together else li
    step = 4 * SPACING
    vx = 4 * F.col("qx") + step * (F.col("pid") % COLUMNS) + whole(F.col("l_discount") * 100) % 3
    vy = 4 * F.col("qy") + step * F.expr(f"pid div {COLUMNS}") + whole(F.col("l_tax") * 100) % 3
    vz = 20 + whole("l_quantity") % 3 + F.when(F.col("pid") % 7 == 3, 15).otherwise(0)
    return li.groupBy("pid", "qx", "qy").agg(F.min(vx).alias("vx"), F.min(vy).alias("vy"), F.min(vz).alias("vz"))


def placed_points(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """pg: pp with its global mesh position gx, gy."""
    return patch_points(spark, d, together).withColumns({"gx": F.col("qx") + SPACING * (F.col("pid") % COLUMNS), "gy": F.col("qy") + SPACING * F.expr(f"pid div {COLUMNS}")})


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """vox(z, y, x, v): 0 or 255; grey has 0..255 in g."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("i", "e"))
    e = e.withColumn("e", F.col("e").cast("double"))
    return e.select(
        "z", F.expr("i div 8").cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"),
        F.when(F.col("e") > 0.02, 255).otherwise(0).cast("long").alias("v"), F.least(F.greatest(F.floor(F.col("e") * 400) + 128, F.lit(0)), F.lit(255)).cast("long").alias("g"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """edge(p1, p2, w): directed relations inside blocks of 25 patches, of weights 1 to 11."""
    li = table(spark, d, "lineitem")
    p2 = F.expr("l_suppkey div 25") * 25 + (F.col("l_suppkey") + 1 + F.col("l_partkey") % 7) % 25
    return li.groupBy(F.col("l_suppkey").alias("p1"), p2.alias("p2")).agg((F.sum(whole(F.col("l_discount") * 100)) % 11 + 1).alias("w"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """rel(p1, p2, w, v0, v2, a..f): a rigid transform and variances for each edge."""
    t = F.pi() * F.col("w") / 8
    return edges(spark, d).select(
        "p1", "p2", "w", (F.col("w") / 1000).alias("v0"), (F.col("w") / 2).alias("v2"),
        F.cos(t).alias("a"), (-F.sin(t)).alias("b"), (4.0 * (F.col("p2") % 5)).alias("c"), F.sin(t).alias("d"), F.cos(t).alias("e"), (4.0 * (F.col("p1") % 5)).alias("f"),
    )


def set_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of surf, some more than once."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.expr("o_custkey div 100").alias("file"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 8).alias("y"), (F.col("l_orderkey") % 64).alias("z"))


def point_sets(spark: SparkSession, d: str) -> DataFrame:
    """surf(file, x, y, z): distinct integer points of each set."""
    return set_points(spark, d).distinct()


def strip_sets(spark: SparkSession, d: str) -> DataFrame:
    """strip(file, x, y, z): a rough sheet cut into sets, each of which lies half on the next one's ground, so partners stay few as sets grow in number."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = li.select(F.expr("o_custkey div 100").alias("file"), (F.col("l_partkey") % 64 + 32 * F.expr("o_custkey div 100")).alias("x"), (F.col("l_orderkey") % 64).alias("z"), (F.col("l_suppkey") % 2).alias("rough"))
    return s.select("file", "x", (F.expr("(x + z) div 16") + F.col("rough")).alias("y"), "z").distinct()


def samples(spark: SparkSession, d: str) -> DataFrame:
    """sample(file, iter, score): logs of iterative runs."""
    return table(spark, d, "events").select((F.col("user_id") % 64).alias("file"), F.col("event_id").alias("iter"), whole(F.col("value") * 100).alias("score"))


SQL = {
    "pp": f"""pp AS (SELECT l_suppkey AS pid, l_partkey%41-20 AS qx, l_orderkey%41-20 AS qy,
  min(4*(l_partkey%41-20)+{4 * SPACING}*(l_suppkey%{COLUMNS})+CAST(round(l_discount*100) AS BIGINT)%3) AS vx,
  min(4*(l_orderkey%41-20)+{4 * SPACING}*(l_suppkey//{COLUMNS})+CAST(round(l_tax*100) AS BIGINT)%3) AS vy,
  min(20+CAST(round(l_quantity) AS BIGINT)%3+CASE WHEN l_suppkey%7=3 THEN 15 ELSE 0 END) AS vz FROM lineitem GROUP BY 1,2,3)""",
    "pg": f"pg AS (SELECT *, qx+{SPACING}*(pid%{COLUMNS}) AS gx, qy+{SPACING}*(pid//{COLUMNS}) AS gy FROM pp)",
    "vox": """vox AS (SELECT z, i//8 AS y, i%8 AS x, CASE WHEN e>0.02 THEN 255 ELSE 0 END::BIGINT AS v,
  CAST(least(greatest(floor(e*400)+128,0),255) AS BIGINT) AS g
  FROM (SELECT vec_id AS z, i::BIGINT-1 AS i, embedding[i]::DOUBLE AS e FROM embeddings, range(1,65) t(i)) WHERE e IS NOT NULL)""",
    "edge": """edge AS (SELECT l_suppkey AS p1, l_suppkey//25*25+(l_suppkey+1+l_partkey%7)%25 AS p2,
  CAST(sum(CAST(round(l_discount*100) AS BIGINT))%11+1 AS BIGINT) AS w FROM lineitem GROUP BY 1,2)""",
    "rel": """rel AS (SELECT p1,p2,w, w/1000 AS v0, w/2 AS v2, cos(pi()*w/8) AS a, -sin(pi()*w/8) AS b, 4.0::DOUBLE*(p2%5) AS c,
  sin(pi()*w/8) AS d, cos(pi()*w/8) AS e, 4.0::DOUBLE*(p1%5) AS f FROM edge)""",
    "surf": """surf AS (SELECT DISTINCT o_custkey//100 AS file, l_partkey%64 AS x, l_suppkey%8 AS y, l_orderkey%64 AS z
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "strip": """strip AS (SELECT DISTINCT file, x, (x+z)//16+rough AS y, z FROM (SELECT o_custkey//100 AS file, l_partkey%64+32*(o_custkey//100) AS x, l_orderkey%64 AS z, l_suppkey%2 AS rough
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey))""",
    "sample": "sample AS (SELECT user_id%64 AS file, event_id AS iter, CAST(round(value*100) AS BIGINT) AS score FROM events)",
}
NEEDS = {"pg": ["pp"], "rel": ["edge"]}


def oracle(views: str, body: str) -> str:
    """A DuckDB query over the named views; ``body`` may begin with further ``name AS (...)`` clauses and a semicolon."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    more, _, select = body.rpartition(";;")
    parts = [SQL[n] for n in names] + ([more] if more.strip() else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select
