"""Common places of sets, and regions of a class, against plain Python."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from lamina.operators import sets
from lamina.operators.ranges import ranked, running_sum
from lamina.operators.sets import common_counts, shared_places
from lamina.operators.voxel import dilated_sets
from lamina.plans import registry
from lamina.plans.voxels import class_regions

from test_graph import least_reachable


def test_common_counts(spark):
    """Repeated rows, a hot place that all keys share, places with the same keys, extra columns of clashing names; empty sets have no pairs."""
    rng = random.Random(8)
    rows = [(k, 0, 0) for k in range(40)] + [(k, x, 1) for k in (3, 4, 5) for x in range(200)] + [(rng.randrange(40), rng.randrange(30), 2) for _ in range(400)]
    rows += rows[:50]
    df = spark.createDataFrame([(k, x, y, 1, 2, 3) for k, x, y in rows], "k long, x long, y long, a long, b long, _n long")
    at = {}
    for k, x, y in rows:
        at.setdefault((x, y), set()).add(k)
    want = Counter(pair for ks in at.values() for pair in combinations(sorted(ks), 2))
    got = common_counts(df, "k", ["x", "y"], "common").collect()
    assert {(r.a, r.b): r.common for r in got} == want and len(got) == len(want)
    shared = {tuple(r) for r in shared_places(df, "k", ["x", "y"]).select("k", "x", "y").collect()}
    assert shared == {(k, *p) for p, ks in at.items() if len(ks) > 1 for k in ks}
    assert common_counts(df.limit(0), "k", ["x", "y"], "common").count() == 0


def test_common_counts_null(spark):
    """A null coordinate is no place to meet."""
    df = spark.createDataFrame([(1, None), (2, None), (1, 5), (2, 5)], "k long, x long")
    assert [tuple(r) for r in common_counts(df, "k", ["x"], "n").collect()] == [(1, 2, 1)]


def test_class_regions(spark, tmp_path):
    """Regions of one grey class above the least volume, with their boxes, against a flood fill."""
    rng = random.Random(6)
    grid = {z: [rng.choice((0.05, 0.05, 0.3, -0.2)) for _ in range(64)] for z in range(60)}
    spark.createDataFrame(list(grid.items()), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    on = {64 * z + i for z, e in grid.items() for i, v in enumerate(e) if v == 0.05}
    near = [(v, v + s) for v in on for s, inside in ((1, v % 8 < 7), (8, v // 8 % 8 < 7), (64, True)) if inside and v + s in on]
    members = {}
    for v, c in least_reachable([*near, *((v, v) for v in on)]).items():
        members.setdefault(c, []).append((v // 64, v // 8 % 8, v % 8))
    want = {(c, len(m), *map(min, zip(*m)), *map(max, zip(*m))) for c, m in members.items() if len(m) > 8}
    got = class_regions(spark, str(tmp_path)).select("label", "volume", "z0", "y0", "x0", "z1", "y1", "x1").collect()
    assert {tuple(r) for r in got} == want and want and len(got) == len(want)


def test_running_sum(spark):
    """Over ranges of an order with gaps, nulls as nothing, whatever the number of partitions; an empty table stays empty."""
    rng = random.Random(9)
    rows = [(k * k * k, rng.choice((None, 1, 5, -2))) for k in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    total, want = 0, set()
    for k, v in sorted(rows):
        total += v or 0
        want.add((k, v, total))
    assert {tuple(r) for r in running_sum(df, "k", F.col("v"), "upto").collect()} == want
    assert [r["rank"] for r in ranked(df, "k").orderBy("k").collect()] == list(range(1, 301))
    assert running_sum(df.where("false"), "k", F.col("v"), "upto").count() == 0


def test_common_counts_crowded(spark):
    """Places of more keys than are paired as rows, some alike, with keys of several blocks that do not follow one another, beside places of few keys."""
    rng = random.Random(10)
    keys = [7 * k - 500 for k in range(1100)]
    at = {x: set(rng.sample(keys, 150 + 200 * x)) for x in range(3)}
    at |= {x: set(keys[:90]) for x in range(3, 6)} | {x: set(rng.sample(keys, 5)) for x in range(6, 30)}
    df = spark.createDataFrame([(k, x) for x, ks in at.items() for k in ks], "k long, x long").repartition(5)
    want = Counter(pair for ks in at.values() for pair in combinations(sorted(ks), 2))
    got = common_counts(df, "k", ["x"], "n")
    assert got.count() == len(want)
    assert {(r.a, r.b): r.n for r in got.collect()} == want
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()  # crowded places are not paired as rows


def test_overlap_reads_point_sets():
    """The whole point sets, in which each set meets most others, not sets that stand along a strip."""
    for name in ("set_overlap", "shared_boundary"):
        assert "FROM surf" in registry.SQL[name] and "strip" not in registry.SQL[name]


def met(left, right):
    return Counter((a, b) for a, *p in set(left) for b, *q in set(right) if p == q)


def test_met_counts(spark):
    """Repeated rows, nulls, keys of several blocks, places of many keys (counted by products) and of few; in several parts; further columns of the keys."""
    rng = random.Random(12)
    left = [(3 * k, x, 0) for k in range(1100) for x in range(2) if rng.random() < 0.3] + [(3 * rng.randrange(1100), rng.randrange(40), 1) for _ in range(500)]
    right = [(5 * k, x, 0) for k in range(1050) for x in range(2) if rng.random() < 0.3] + [(5 * rng.randrange(1050), rng.randrange(40), 1) for _ in range(500)]
    table = lambda rows, side: spark.createDataFrame([*rows, *rows[:9], (1, None, 1), (None, 1, 1)], f"{side} long, x long, y long").repartition(3)
    a, b = table(left, "a"), table(right, "b")
    n = a.select("a").distinct().withColumn("na", F.col("a") + 1)
    got = sets.met_counts(a, b, ["x", "y"], "n", keys=(n, b.select("b").distinct()))
    rows, want = got.collect(), met(left, right)
    assert {(r.a, r.b): r.n for r in rows} == want and len(rows) == len(want) and all(r.na == r.a + 1 for r in rows)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()
    before, sets.TASK_PLACES = sets.TASK_PLACES, 7
    try:
        assert {(r.a, r.b): r.n for r in sets.met_counts(a, b, ["x", "y"], "n").collect()} == want
    finally:
        sets.TASK_PLACES = before
    assert sets.met_counts(a.limit(0), b, ["x", "y"], "n").count() == 0


def test_met_counts_grown(spark):
    """Places of one side spread to their neighbours; where they overlap they count once."""
    rng = random.Random(13)
    left, right = ([(k, rng.randrange(12), rng.randrange(12)) for k in range(20) for _ in range(30)] for _ in range(2))
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    got = sets.met_counts(spark.createDataFrame(left, "a long, x long, y long"), spark.createDataFrame(right, "b long, x long, y long"), ["x", "y"], "n", grown=steps).collect()
    assert {(r.a, r.b): r.n for r in got} == met([(a, x + i, y + j) for a, x, y in left for i, j in steps], right)


def test_dilated_sets(spark):
    """Points at the ends of words and tiles, below zero, repeated; sets of their own; a null is no point. Rows are shuffled once."""
    rng = random.Random(14)
    ends_ = (-65, -64, -1, 0, 1, 62, 63, 64, 127, 128)
    points = [(k, rng.choice(ends_), rng.choice(ends_), rng.choice(ends_)) for k in (1, 2) for _ in range(150)]
    df = spark.createDataFrame([*points, *points[:20], (3, None, 1, 1), (None, 1, 1, 1)], "file long, x long, y long, z long").repartition(3)
    near = (-1, 0, 1)
    want = {(k, x + a, y + b, z + c) for k, x, y, z in points for a in near for b in near for c in near}
    got = dilated_sets(df, "file")
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    plan = dilated_sets(spark.range(5).selectExpr("id as file", "id as x", "id as y", "id as z"), "file")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
