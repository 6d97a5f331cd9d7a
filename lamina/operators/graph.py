"""Graph operators as joins: components, bounded search, walks, shortest paths, visit order.

Loops hold scalars on the driver; every round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranges import ranked
from lamina.sources.scratch import saved


def undirected(edges: DataFrame, a: str = "p1", b: str = "p2") -> DataFrame:
    """(src, dst) in both directions, once each, without loops."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(F.col(b), F.col(a))).where("src <> dst").distinct()


def roots(up: DataFrame) -> DataFrame:
    """(id, root): pointers (id, root) to equal or lesser ids, each followed to its end; doubles the way followed each time."""
    while True:
        top = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
        after = saved(up.join(top, "root").select("id", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")))
        up = after.select("id", "root")
        if not after.where("moved").limit(1).count():
            return up


def components(edges: DataFrame, a: str = "p1", b: str = "p2") -> DataFrame:
    """(id, component): the least id reachable.

    Each round every vertex points to its least neighbour, pointers are followed to their roots and edges
    are contracted to roots. A root is the least id of what it stands for, and the tables shrink with each
    round, so a component of great diameter needs few rounds.
    """
    both = saved(undirected(edges, a, b))
    of = None
    while True:
        up = roots(saved(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("root"))))
        if of is None:
            of = up.select("id", F.col("root").alias("component"))
        else:
            of = of.join(up.withColumnRenamed("id", "component"), "component", "left")
            of = saved(of.select("id", F.coalesce("root", "component").alias("component")))
        for end in ("src", "dst"):
            both = both.join(up.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("root", end)
        both = saved(both.where("src <> dst").select("src", "dst").distinct())
        if not both.limit(1).count():
            return of


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): vertices at most ``hops`` edges from any seed, with the least number."""
    both = undirected(edges)
    reached = seeds.select(F.col("id"), F.lit(0).alias("hop")).distinct()
    for h in range(1, hops + 1):
        step = reached.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.lit(h).alias("hop"))
        reached = saved(reached.union(step).groupBy("id").agg(F.min("hop").alias("hop")))
    return reached


def walks(edges: DataFrame, vertices: int, banned: DataFrame | None = None) -> DataFrame:
    """(v0, v1, ...): all walks of that many vertices along directed edges; vertices may come again."""
    e = edges.select("p1", "p2").distinct()
    if banned is not None:
        for end in ("p1", "p2"):
            e = e.join(banned.select(F.col("id").alias(end)), end, "left_anti")
    out = e.select(F.col("p1").alias("v0"), F.col("p2").alias("v1"))
    for k in range(2, vertices):
        out = out.join(e.select(F.col("p1").alias(f"v{k - 1}"), F.col("p2").alias(f"v{k}")), f"v{k - 1}")
    return out.select(*(f"v{k}" for k in range(vertices)))


def shortest_paths(edges: DataFrame, source: DataFrame, limit: float | None = None) -> DataFrame:
    """(id, cost, prev, hops): least cost from the sources over undirected weighted edges of at most ``limit``.

    Rounds relax the frontier (rows that improved) only; ties go to fewer hops, then the least predecessor.
    """
    e = edges.where(F.col("w") <= limit) if limit is not None else edges
    both = saved(e.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), "w").union(e.select("p2", "p1", "w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = saved(source.select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("prev"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")))
    while best.where("fresh").limit(1).count():
        step = best.where("fresh").join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("id").alias("prev"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("fresh"))
        every = best.withColumn("fresh", F.lit(False)).union(step)
        order = F.struct("cost", "hops", F.coalesce("prev", F.lit(-1).cast("long")).alias("p"), "fresh")
        best = saved(every.groupBy("id").agg(F.min(order).alias("m"), F.min_by("prev", order).alias("prev")).select("id", "m.cost", "prev", "m.hops", "m.fresh"))
    return best.drop("fresh")


def forced_runs(both: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(id, head, pos): the vertices that must follow a head one after the other, as each has a single way on inside its group.

    ``rows`` are (id, head). Steps along edges are ranked by doubling pointers, so a run of any length takes few rounds.
    None where no group begins with two such vertices.
    """
    member = lambda side: rows.select(F.col("id").alias(side), F.col("head").alias(f"{side}_head"))
    inner = both.join(member("src"), "src").join(member("dst"), "dst").where("src_head = dst_head").select(F.col("src_head").alias("head"), "src", "dst")
    entry = both.join(member("dst"), "dst").where("src = dst_head").select(F.col("dst_head").alias("head"), "src", "dst")
    steps = saved(inner.union(entry).union(entry.select("head", F.col("dst").alias("src"), F.col("src").alias("dst"))))
    degree = steps.groupBy("head", "src").agg(F.count("*").alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high"))
    narrow = degree.where("src = head and n = 1").select("head", F.col("low").alias("src"))
    begun = saved(degree.where("n = 2").join(narrow, ["head", "src"], "left_semi").select("head"))
    if not begun.limit(1).count():
        return None
    before = F.when((F.col("n") == 2) & (F.col("src") != F.col("head")), F.when(F.col("dst") == F.col("high"), F.col("low")).otherwise(F.col("high")))
    at = steps.join(begun, "head").join(degree, ["head", "src"]).withColumn("b", before)
    at = saved(at.select("head", "src", "dst", F.coalesce("b", "src").alias("fs"), F.when(F.col("b").isNull(), F.col("dst")).otherwise(F.col("src")).alias("fd"), F.col("b").isNotNull().cast("long").alias("far")))
    while True:
        front = at.select("head", F.col("src").alias("fs"), F.col("dst").alias("fd"), F.col("fs").alias("gs"), F.col("fd").alias("gd"), F.col("far").alias("more"))
        after = saved(at.join(front, ["head", "fs", "fd"]).select("head", "src", "dst", F.col("gs").alias("fs"), F.col("gd").alias("fd"), (F.col("far") + F.col("more")).alias("far"), "more"))
        at = after.drop("more")
        if not after.where("more > 0").limit(1).count():
            return saved(at.where("fs = head").select(F.col("dst").alias("id"), "head", (F.col("far") + 1).alias("pos")))


def visit_order(edges: DataFrame) -> DataFrame:
    """(component, ord, id): each component from its least vertex on, always going to the least vertex seen and not visited.

    Instead of one queue, the order is found as nested groups. Inside a group with head h, a vertex belongs to
    the record b that has to be passed on the way to it: the least possible maximum over the paths from h.
    Records are taken in order, and what a record opens is visited, in the same manner, before the next record.
    So each round splits all groups of all components at once, and the chain of records of a vertex is its place.
    Runs without a choice are passed first, in one round whatever their length. Rounds are as many as records with
    a choice nest; each relaxes to a fixed point.
    """
    both = saved(undirected(edges))
    label = components(edges)
    rows = saved(label.select("id", F.col("component").alias("head"), F.array("component").alias("chain")))
    done = rows.where("id = head")
    rows = saved(rows.where("id <> head"))
    while rows.limit(1).count():
        run = forced_runs(both, rows.select("id", "head"))
        if run is not None:
            done = done.union(rows.join(run.select("id", "pos"), "id").select("id", F.col("id").alias("head"), F.array_append("chain", F.col("pos")).alias("chain")))
            last = run.groupBy("head").agg(F.max("pos").alias("pos"), F.max_by("id", "pos").alias("last"))
            left = rows.join(run.select("id"), "id", "left_anti").join(last, "head", "left")
            chain = F.when(F.col("last").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("pos")))
            rows = saved(left.select("id", F.coalesce("last", "head").alias("head"), chain.alias("chain")))
        end = lambda side, keep: rows.select(F.col("id").alias(side), F.col("head").alias(f"{side}_head"), *keep)
        inner = saved(both.join(end("src", []), "src").join(end("dst", []), "dst").where("src_head = dst_head").select("src", "dst"))
        opened = both.join(rows, F.col("dst") == F.col("id")).where("src = head").select("id", F.col("id").alias("record"))
        reach = saved(opened.distinct())
        while True:
            step = reach.join(inner, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.greatest("record", "dst").alias("record"))
            after = saved(reach.withColumn("old", F.col("record")).unionByName(step.withColumn("old", F.lit(None).cast("long"))).groupBy("id").agg(F.min("record").alias("record"), F.max("old").alias("old")))
            reach = after.select("id", "record")
            if not after.where("old is null or record < old").limit(1).count():
                break
        split = saved(rows.join(reach, "id").select("id", F.col("record").alias("head"), F.array_append("chain", F.col("record")).alias("chain")))
        done = done.union(split.where("id = head"))
        rows = split.where("id <> head")
    every = ranked(done.select(F.col("chain")[0].alias("component"), "chain", "id"), "chain")
    first = every.groupBy("component").agg(F.min("rank").alias("first"))
    return every.join(first, "component").select("component", (F.col("rank") - F.col("first") + 1).alias("ord"), "id")
