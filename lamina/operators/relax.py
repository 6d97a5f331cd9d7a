"""Iterative solvers as joins: placement along relations, springs between placements, annealing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators.graph import saved

MAP = "a b c d e f"


def place(relations: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(p, level, from_p, a..f): patches placed level by level from the roots.

    A patch reached by several placed neighbours of one level takes the one of largest (w, p1); the
    relation maps the new patch's frame into its neighbour's. One join per level, until none is new.
    """
    rel = saved(relations.select("p1", "p2", "w", *MAP.split()))
    one = [F.lit(float(v)).alias(k) for k, v in zip(MAP.split(), (1, 0, 0, 0, 1, 0), strict=True)]
    placed = saved(roots.select(F.col("id").alias("p"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("from_p"), *one))
    level = 0
    while rounds is None or level < rounds:
        level += 1
        front = placed.where(F.col("level") == level - 1)
        j = front.alias("m").join(rel.alias("n"), F.col("m.p") == F.col("n.p1"))
        out = g.compose(g.cols(MAP, "m."), g.cols(MAP, "n."))
        new = j.select(F.col("n.p2").alias("p"), F.struct(F.col("n.w").alias("w"), F.col("n.p1").alias("from_p"), *(c.alias(k) for k, c in zip(MAP.split(), out, strict=True))).alias("t"))
        new = new.join(placed.select("p"), "p", "left_anti").groupBy("p").agg(F.max_by("t", F.struct("t.w", "t.from_p")).alias("t"))
        new = saved(new.select("p", F.lit(level).alias("level"), "t.from_p", *(F.col(f"t.{k}") for k in MAP.split())))
        if not new.limit(1).count():
            break
        placed = saved(placed.union(new))
    return placed


def springs(placement: DataFrame, connections: DataFrame, steps: int, stiffness: float, turn: float, friction: float = 0.6, save_every: int = 5) -> DataFrame:
    """(pid, x, y, angle) after ``steps`` explicit steps of position and angle springs.

    connections(p1, p2, dist, turn1, turn2): each end wants the other at ``dist`` in its own frame's
    direction. Both ends' pulls are summed per patch before the shuffle.
    """
    state = placement.select("pid", "x", "y", "angle", *(F.lit(0.0).alias(v) for v in ("vx", "vy", "va")))
    c = saved(connections)
    for step in range(steps):
        ends = [state.select(*(F.col(k).alias(f"{k}{i}") for k in ("pid", "x", "y", "angle"))) for i in (1, 2)]
        j = c.join(ends[0], F.col("p1") == F.col("pid1")).join(ends[1], F.col("p2") == F.col("pid2"))
        want1 = g.add_angle(F.col("turn1"), F.col("angle1"))
        want2 = g.add_angle(F.col("turn2"), F.col("angle2"))
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        ex = (dx - F.cos(want1) * F.col("dist")) + (dx + F.cos(want2) * F.col("dist"))
        ey = (dy - F.sin(want1) * F.col("dist")) + (dy + F.sin(want2) * F.col("dist"))
        ea = g.add_angle(F.atan2(dy, dx), -want1) - g.add_angle(F.atan2(-dy, -dx), -want2)
        pull = j.select(F.explode(F.array(*(F.struct(F.col(f"p{i}").alias("pid"), (s * stiffness * ex).alias("ax"), (s * stiffness * ey).alias("ay"), (s * turn * ea).alias("aa")) for i, s in ((1, 1.0), (2, -1.0))))).alias("f"))
        force = pull.groupBy("f.pid").agg(*(F.sum(f"f.{k}").alias(k) for k in ("ax", "ay", "aa")))
        moved = state.join(force, "pid", "left")
        speed = {k: (F.col(k) + F.coalesce(a, F.lit(0.0))) * friction for k, a in (("vx", "ax"), ("vy", "ay"), ("va", "aa"))}
        state = moved.select("pid", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), (F.col("angle") + F.col("va")).alias("angle"), *(v.alias(k) for k, v in speed.items()))
        if (step + 1) % save_every == 0:
            state = saved(state)
    return state.select("pid", "x", "y", "angle")


def anneal(patches: DataFrame, mismatch: DataFrame, rounds: int, candidates: int = 4, start: float = 50.0, penalty: float = 10.0, seed: int = 1) -> DataFrame:
    """(iter, pid, score): the excluded patch toggled at each accepted step of a simulated annealing.

    A state is a set of excluded patches; its score is the number of kept patches less ``penalty`` for
    each mismatched pair that is kept. All candidates of a round are scored by one grouped join; the
    draws come from hashes of (seed, round, candidate), so partitioning does not matter.
    """
    spark = patches.sparkSession
    n = patches.count()
    keyed = saved(patches.select("pid").distinct())
    pairs = saved(mismatch.select("a", "b"))
    out = saved(keyed.where("false").select("pid"))
    log, score = [], float(n) - penalty * pairs.count()
    for it in range(rounds):
        heat = start * (1 - it / rounds)
        order = [F.xxhash64(F.lit(seed), F.lit(it), F.lit(k), "pid") for k in range(candidates)]
        drawn = keyed.agg(*(F.min_by("pid", o).alias(f"c{k}") for k, o in enumerate(order))).first()
        tries = spark.createDataFrame([(k, drawn[k]) for k in range(candidates)], "cand int, pid long")
        inside = {r["pid"] for r in out.join(F.broadcast(tries), "pid", "left_semi").collect()}  # at most the candidates
        free = pairs.join(out, F.col("a") == F.col("pid"), "left_anti").join(out, F.col("b") == F.col("pid"), "left_anti")
        all_ = {r["pid"]: r["n"] for r in (pairs if inside else free).join(F.broadcast(tries.select("pid").distinct()), F.col("pid").isin(F.col("a"), F.col("b"))).groupBy("pid").agg(F.count("*").alias("n")).collect()}
        if inside:
            kept = free.join(F.broadcast(tries.select("pid").distinct()), F.col("pid").isin(F.col("a"), F.col("b"))).groupBy("pid").agg(F.count("*").alias("n"))
            held = {r["pid"]: r["n"] for r in kept.collect()}
            all_ = {p: held.get(p, 0) if p not in inside else all_.get(p, 0) for p in {c[0] for c in zip(drawn)}}
        done = False
        for k in range(candidates):
            p = drawn[k]
            gain = penalty * all_.get(p, 0) - 1
            gain = -gain if p in inside else gain
            luck = (hash((seed, it, k)) % 1_000_003) / 1_000_003
            if not done and (gain > 0 or luck < math.exp(min(0.0, gain) / max(heat, 1e-9))):
                score += gain
                one = spark.createDataFrame([(p,)], "pid long")
                out = saved(out.join(one, "pid", "left_anti") if p in inside else out.union(one))
                log.append((it, p, score))
                done = True
    return spark.createDataFrame(log, "iter int, pid long, score double")
