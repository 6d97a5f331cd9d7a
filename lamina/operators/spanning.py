"""A random connected order of patches, drawn by fixed hashes: least spanning forest, its rooting, and the order of growth.

Every step is a number of joins that grows with the logarithm of the graph: the forest by rounds in which each
component takes its least edge, the rooting by ranking the tour around each tree with doubled pointers, the order by
halving the ranks of the edges. No task walks a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.graph import components, undirected
from lamina.operators.ranges import ranked
from lamina.sources.scratch import saved


def drawn(edges: DataFrame) -> DataFrame:
    """(p, q, h): each undirected edge once, p < q, with its draw."""
    e = undirected(edges).where("src < dst").select(F.col("src").alias("p"), F.col("dst").alias("q"))
    return e.withColumn("h", F.pmod(F.col("p") * 7919 + F.col("q") * 104729 + F.col("p") * F.col("q") * 31, F.lit(1000003)))


def least_forest(edges: DataFrame) -> DataFrame:
    """(p, q, h) of the spanning forest of least draws; ties go by (p, q), so it is unique."""
    left = saved(edges.select("p", "q", "h", F.col("p").alias("a"), F.col("q").alias("b")))
    out = None
    while left.limit(1).count():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("x"), "h", "p", "q")
        least = ends.groupBy("x.of").agg(F.min(F.struct("h", "p", "q", "x.of", "x.to")).alias("m"))
        chosen = saved(least.select("m.*").groupBy("p", "q", "h").agg(F.min(F.struct("of", "to")).alias("x")).select("p", "q", "h", F.col("x.of").alias("p1"), F.col("x.to").alias("p2")))
        out = chosen.drop("p1", "p2") if out is None else out.unionByName(chosen.drop("p1", "p2"))
        of = components(chosen)
        for end in ("a", "b"):
            left = left.join(of.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("component", end)
        left = saved(left.where("a <> b"))
    return out if out is not None else left.select("p", "q", "h")


def rooted(forest: DataFrame) -> DataFrame:
    """(component, id, up, p, q, h): each vertex of a tree but the least below the neighbour on the way to the least.

    The tour around a tree passes each edge both ways; a vertex is entered first from above. Places on the tour
    come from doubled pointers.
    """
    of = components(forest, "p", "q")
    both = forest.select(F.col("p").alias("v"), F.col("q").alias("n")).union(forest.select("q", "p")).join(of.withColumnRenamed("id", "v"), "v")
    around = Window.partitionBy("v").orderBy("n")
    after = F.lead("n").over(around)
    again = F.first("n").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the tour comes to v from n and goes on to the neighbour after n; it ends where it would leave the root anew
    on = F.when(after.isNotNull(), after).when(F.col("v") != F.col("component"), again)
    tour = saved(both.select("component", F.col("n").alias("u"), "v", F.when(on.isNotNull(), F.col("v")).alias("su"), on.alias("sv")).withColumn("far", F.col("su").isNotNull().cast("long")))

    def doubled(tour):
        more = tour.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("su").alias("_su"), F.col("sv").alias("_sv"), F.col("far").alias("_far"))
        return tour.join(more, ["su", "sv"], "left").select("component", "u", "v", F.col("_su").alias("su"), F.col("_sv").alias("sv"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"))

    while tour.where("su is not null").limit(1).count():
        tour = saved(doubled(doubled(tour)))
    down, back = tour.select("component", "u", "v", "far"), tour.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("far").alias("back"))
    up = down.join(back, ["u", "v"]).where("far > back").select("component", F.col("v").alias("id"), F.col("u").alias("up"), F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    return up.join(forest, ["p", "q"])


def _followed(pointers: DataFrame) -> DataFrame:
    """(id, head): pointers (id, head), of which the last of each chain points to itself, followed to their ends."""
    at = saved(pointers)
    while True:
        step = at.select(F.col("id").alias("head"), F.col("head").alias("_head"))
        twice = at.join(step, "head").select("id", F.col("_head").alias("head"))
        far = twice.select(F.col("id").alias("head"), F.col("head").alias("_head"))
        after = saved(twice.join(far, "head").select("id", F.col("_head").alias("head"), (F.col("_head") != F.col("head")).alias("moved")))
        at = after.select("id", "head")
        if not after.where("moved").limit(1).count():
            return at


def growth_order(edges: DataFrame) -> DataFrame:
    """(component, ord, id, parent): from the least vertex on, always over the edge of least draw that leads to a new vertex.

    What the edges up to a rank join is finished before a greater one is taken. So with the ranks halved, a vertex's
    place is its place in its own part of the lower half plus that of its part in the upper half, where a part
    weighs as many vertices as it holds; both are problems of the same kind, all of which are halved in one go. A problem
    of one edge has its upper end first.
    """
    tree = saved(rooted(saved(least_forest(drawn(edges)))))
    order = saved(ranked(tree.withColumn("_o", F.struct("h", "p", "q")), "_o"))
    bits = max(0, order.count() - 1).bit_length()
    rows = saved(order.select(F.col("id").cast("string").alias("id"), F.col("up").cast("string").alias("up"), (F.col("rank") - 1).alias("w")))
    size = saved(rows.select("id").union(rows.select("up")).distinct().withColumn("size", F.lit(1).cast("long")))
    heads = []
    for level, bit in enumerate(reversed(range(bits))):
        is_low = F.getbit("w", F.lit(bit)) == 0
        nodes = rows.select("id").union(rows.select("up")).distinct()
        head = _followed(nodes.join(rows.where(is_low), "id", "left").select("id", F.coalesce("up", "id").alias("head")))
        heads.append(head)
        name = lambda c: F.concat(F.lit(f"{level}."), c)  # noqa: B023, E731
        high = rows.where(~is_low).join(head.select(F.col("id").alias("up"), F.col("head").alias("_up")), "up").select(name(F.col("id")).alias("id"), name(F.col("_up")).alias("up"), "w")
        whole = size.join(head, "id").groupBy("head").agg(F.sum("size").alias("size")).select(name(F.col("head")).alias("id"), "size")
        rows = saved(rows.where(is_low).unionByName(high))
        alive = rows.select("id").union(rows.select("up")).distinct()
        size = saved(size.unionByName(whole).join(alive, "id", "left_semi"))
    place = rows.join(size.withColumnRenamed("id", "up"), "up").select("id", F.col("size").alias("place"))
    for level, head in reversed(list(enumerate(heads))):
        inner = place.withColumnRenamed("place", "_in")
        outer = place.select(F.col("id").alias("_of"), F.col("place").alias("_out"))
        both = head.withColumn("_of", F.concat(F.lit(f"{level}."), F.col("head"))).join(inner, "id", "left").join(outer, "_of", "left")
        place = saved(both.select("id", (F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))).alias("place")))
    place = place.select(F.col("id").cast("long").alias("id"), "place")
    below = tree.join(place, "id").select("component", (F.col("place") + 1).alias("ord"), "id", F.col("up").alias("parent"))
    top = tree.select("component").distinct().select("component", F.lit(1).cast("long").alias("ord"), F.col("component").alias("id"), F.lit(None).cast("long").alias("parent"))
    return top.unionByName(below)
