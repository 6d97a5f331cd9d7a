"""Walks over relations: without revisits, and as evidence of bad patches; greedy removal; paths from predecessors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators.ends import TX, compared_ends
from lamina.operators.mesh import normals
from lamina.operators.ranges import ranked
from lamina.sources.scratch import saved



def frames(relations: DataFrame) -> DataFrame:
    """(src, dst, a ... f) both ways: the map of dst's frame into src's; a relation stored this way round comes before the other's inverse."""
    forward = relations.where("p1 <> p2").select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.struct(F.lit(0).alias("o"), *TX.split()).alias("t"))
    back = relations.where("p1 <> p2").select(F.col("p2").alias("src"), F.col("p1").alias("dst"), F.struct(F.lit(1).alias("o"), *(c.alias(n) for c, n in zip(g.rigid_inverse(g.cols(TX)), TX.split(), strict=True))).alias("t"))
    return forward.union(back).groupBy("src", "dst").agg(F.min("t").alias("t")).select("src", "dst", *(F.col(f"t.{c}").alias(c) for c in TX.split()))


def step_rank(walk: Column, step: int, dst: Column) -> Column:
    """A fixed draw for a step of a walk, in place of a random state."""
    return F.pmod(walk * 7919 + dst * 104729 + F.lit(step * 1299709), F.lit(1000003))


def self_avoiding_walks(relations: DataFrame, starts: DataFrame, vertices: int, banned: DataFrame | None = None) -> DataFrame:
    """(walk, step, id, a ... f): from each start (``id``), always to the neighbour of least draw that the walk has not met.

    A walk ends after ``vertices`` patches or where every neighbour is banned or was met; a start that is banned or
    has no relation is a walk of one. Each row has the patch's frame in that of the walk's first patch.
    """
    steps = frames(relations)
    if banned is not None:
        steps = steps.join(banned.select(F.col("id").alias("dst")), "dst", "left_anti").join(banned.select(F.col("id").alias("src")), "src", "left_anti")
    steps = saved(steps.select(F.col("src").alias("id"), "dst", F.struct(*TX.split()).alias("t")))
    one = [F.lit(float(v)).alias(n) for v, n in zip((1, 0, 0, 0, 1, 0), TX.split(), strict=True)]
    at = saved(starts.select("id").distinct().select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id", F.array("id").alias("met"), *one))
    out = [at]
    for k in range(1, vertices):
        new = at.join(steps, "id").where(~F.array_contains("met", F.col("dst")))
        rank = F.struct(step_rank(F.col("walk"), k, F.col("dst")), "dst")
        new = new.groupBy("walk").agg(F.min_by(F.struct("dst", "t", "met", *TX.split()), rank).alias("m"))
        both = g.compose([F.col(f"m.{c}") for c in TX.split()], [F.col(f"m.t.{c}") for c in TX.split()])
        at = saved(new.select("walk", F.lit(k).alias("step"), F.col("m.dst").alias("id"), F.array_append("m.met", F.col("m.dst")).alias("met"), *(c.alias(n) for c, n in zip(both, TX.split(), strict=True))))
        if not at.limit(1).count():
            break
        out.append(at)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.drop("met")


# ---- bad patches --------------------------------------------------------------------------------


def with_normals(points: DataFrame) -> DataFrame:
    """Mesh points with their normals; a missing one is zero, so that it says nothing of a distance."""
    n = points.join(normals(points), ["pid", "qx", "qy"], "left")
    return n.select("pid", "qx", "qy", "vx", "vy", "vz", *(F.coalesce(f"n{a}", F.lit(0.0)).alias(f"n{a}") for a in "xyz"))


def walks_of(relations: DataFrame, length: int, banned: DataFrame | None = None) -> DataFrame:
    """(v0, v1, ..., a ... f): walks of ``length`` patches, v_k related to the one before, with the last one's frame in the first one's. Patches may come again."""
    r = relations.where("p1 <> p2").select("p1", "p2", *TX.split())
    if banned is not None:
        for end in ("p1", "p2"):
            r = r.join(banned.select(F.col("id").alias(end)), end, "left_anti")
    walk = r.select(F.col("p2").alias("v0"), F.col("p1").alias("v1"), *TX.split())
    for k in range(2, length):
        more = r.select(F.col("p2").alias(f"v{k - 1}"), F.col("p1").alias(f"v{k}"), *(F.col(c).alias(f"_{c}") for c in TX.split()))
        both = g.compose(g.cols(TX), g.cols(TX, "_"))
        walk = walk.join(more, f"v{k - 1}").select(*(f"v{i}" for i in range(k + 1)), *(c.alias(n) for c, n in zip(both, TX.split(), strict=True)))
    return walk


def rendered_walks(relations: DataFrame, points: DataFrame, lengths: Sequence[int], banned: DataFrame | None = None) -> DataFrame:
    """(v0, v1, ..., cells, worst) of each walk of so many patches, null beyond the end of shorter ones.

    The last patch's points are brought into the first one's frame along the walk and rounded to its mesh; ``worst`` is
    the greatest distance of points that share a place, taken along either one's normal.
    """
    names = [f"v{i}" for i in range(max(lengths))]
    every = None
    for k in lengths:
        walk = walks_of(relations, k, banned)
        walk = walk.select(F.col("v0").alias("first"), F.col(f"v{k - 1}").alias("last"), *(F.col(n) if i < k else F.lit(None).cast("long").alias(n) for i, n in enumerate(names)), *TX.split())
        every = walk if every is None else every.unionByName(walk)
    return compared_ends(every, points, names, True)


def greedy_removal(tuples: DataFrame, members: str = "members") -> DataFrame:
    """(id, n, round): the patches that go until no tuple is left, always the one in most places (ties: the least id).

    All patches that come first among those they share a tuple with go in one round. They are those that would go
    one by one: nothing that goes before them touches their tuples, so their count stands while their partners' counts
    only fall. ``n`` is the count at which a patch goes; one by one they would go by falling n, then id.
    """
    left = saved(tuples.select(F.col(members).alias("members")).withColumn("t", F.monotonically_increasing_id()))
    out, k = None, 0
    while left.limit(1).count():
        k += 1
        each = left.select("t", F.explode("members").alias("id"))
        count = each.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("t").alias("in_tuples"))
        first = saved(each.join(count, "id").groupBy("t").agg(F.min(F.struct((-F.col("n")).alias("m"), "id", "in_tuples")).alias("b")).select("t", F.col("b.id").alias("id"), (-F.col("b.m")).alias("n"), F.col("b.in_tuples").alias("in_tuples")))
        gone = saved(first.groupBy("id", "n", "in_tuples").agg(F.count("*").alias("won")).where("won = in_tuples").select("id", "n", F.lit(k).alias("round")))
        left = saved(left.join(first.join(gone.select("id"), "id", "left_semi").select("t"), "t", "left_anti"))
        out = gone if out is None else out.unionByName(gone)
    return out if out is not None else left.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("round")).limit(0)


def hitting_set(pairs: DataFrame) -> DataFrame:
    """(id, round): greedy removal of the vertex in most pairs (ties: least id), numbered in the order of one by one."""
    gone = greedy_removal(pairs.select(F.array("a", "b").alias("members")).distinct())
    out = ranked(gone.withColumn("_o", F.struct((-F.col("n")).alias("m"), F.col("id").alias("i"))), "_o")
    return out.select("id", F.col("rank").cast("int").alias("round"))


def bad_patches(relations: DataFrame, points: DataFrame, lengths=(2, 3, 4, 5), limit: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """((id, length, n, round), (first, last, length, worst)): patches removed at each length of walks, and all walks' scores.

    At each length the walks avoid what was removed before; a walk is bad beyond ``limit`` times its steps.
    """
    found = saved(relations.select(F.col("p1").alias("id"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("round")).limit(0))
    points, scores = saved(points), None
    for length in lengths:
        names = [f"v{i}" for i in range(length)]
        walks = saved(rendered_walks(relations, points, [length], found.select("id")))
        bad = walks.where(F.col("worst") > limit * (length - 1)).select(F.array(*names).alias("members"))
        gone = greedy_removal(bad).select("id", F.lit(length).alias("length"), "n", "round")
        found = saved(found.unionByName(gone))
        score = walks.select(F.col("v0").alias("first"), F.col(names[-1]).alias("last"), F.lit(length).alias("length"), "worst")
        scores = score if scores is None else scores.unionByName(score)
    return found, scores


def implausible_bridges(neighbours: DataFrame, places: DataFrame) -> DataFrame:
    """(c, a, b): patches c with two neighbours a < b that lie further apart than c's diameter and both radii allow.

    ``neighbours`` has (src, dst) both ways, ``places`` has (id, x, y, radius).
    """
    at = lambda n: places.select(F.col("id").alias(n), *(F.col(v).alias(f"{n}_{v}") for v in ("x", "y", "radius")))
    near = saved(neighbours.select(F.col("src").alias("c"), F.col("dst").alias("a")).join(at("a"), "a"))
    pairs = near.join(near.withColumnsRenamed({n: n.replace("a", "b", 1) for n in near.columns if n != "c"}), "c").where("a < b").join(at("c"), "c")
    far = g.length([F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")])
    return pairs.where(far > 2.0 * F.col("c_radius") + F.col("a_radius") + F.col("b_radius")).select("c", "a", "b")


def bad_bridges(bridges: DataFrame) -> DataFrame:
    """(id, n, round): the centres that go until no implausible bridge is left, always that of most bridges (ties: the least id).

    A patch that goes takes along the bridges that it is an end of. All centres that come before both ends of all their bridges go in one
    round: only the going of an end could lower their count, and the ends' own counts only fall. So they are
    those that go one by one, with the same counts.
    """
    left, out, k = saved(bridges.select("c", "a", "b").distinct()), None, 0
    while left.limit(1).count():
        k += 1
        count = saved(left.groupBy("c").agg(F.count("*").alias("n")))
        rows = left.join(count, "c")
        for end in ("a", "b"):
            rows = rows.join(count.select(F.col("c").alias(end), F.col("n").alias(f"n_{end}")), end, "left")
        behind = lambda e: F.coalesce((F.col(f"n_{e}") < F.col("n")) | ((F.col(f"n_{e}") == F.col("n")) & (F.col(e) > F.col("c"))), F.lit(True))
        first = rows.groupBy("c", "n").agg(F.min(behind("a") & behind("b")).alias("first")).where("first")
        gone = saved(first.select(F.col("c").alias("id"), "n", F.lit(k).alias("round")))
        for m in ("c", "a", "b"):
            left = left.join(gone.select(F.col("id").alias(m)), m, "left_anti")
        left = saved(left)
        out = gone if out is None else out.unionByName(gone)
    return out if out is not None else left.select(F.col("c").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("round"))


# ---- paths --------------------------------------------------------------------------------------


def paths(best: DataFrame) -> DataFrame:
    """(id, path): the vertices from a source to each vertex, by doubling the way along ``prev`` in each round."""
    up = saved(best.select("id", F.col("prev").alias("up"), F.array("id").alias("path")))
    while up.where("up is not null").limit(1).count():
        more = up.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        up = saved(up.join(more, "up", "left").select("id", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<long>")), "path").alias("path")))
    return up.select("id", "path")
