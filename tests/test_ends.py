"""Ends of walks laid on one another, against loops over points."""

import math
import random

import pytest

from lamina.operators.ends import compared_ends
from lamina.operators.walks import with_normals

NAMES = "pid long, qx long, qy long, vx long, vy long, vz long"


def rounded(x):
    w = math.trunc(x)
    return w if x - w < 0.5 else w + 1


@pytest.mark.parametrize(("normal", "far", "block", "piece"), [(True, 0, 1 << 15, 1 << 18), (True, 0, 60, 100), (False, 0, 1, 1), (False, 10**7, 60, 1 << 18)])
def test_compared_ends(spark, normal, far, block, piece):
    """Blocks of all, some and single patches, any pieces, patches with a far point, whose box is too large for a table; walks without a shared place or a patch have no row."""
    rng = random.Random(3)
    points = [(5 * p, x, y, 4 * x + rng.randint(0, 2), 4 * y + rng.randint(0, 2), rng.randint(0, 9)) for p in range(8) for x in range(-3, 4) for y in range(-3, 4) if rng.random() < 0.8]
    points += [(5 * p, far + p, far, 1, 2, 3) for p in range(8) if far]
    walks = []
    for k in range(60):
        t, first, last = rng.choice([0, math.pi / 2, math.pi / 7]), 5 * rng.randrange(9), 5 * rng.randrange(8)
        walks.append((first, k if k % 3 else None, last, math.cos(t), -math.sin(t), rng.choice([0.0, 2.5, 900.0]), math.sin(t), math.cos(t), float(rng.randint(-2, 2))))
    df = spark.createDataFrame(points, NAMES).repartition(3)
    at = {tuple(r)[:3]: tuple(r)[3:] for r in with_normals(df).collect()}
    assert len(at) == len(points)
    want = []
    for first, k, last, a, b, c, d, e, f in walks:
        gaps = []
        for (p, x, y), v in at.items():
            u = at.get((first, rounded(a * x + b * y + c), rounded(d * x + e * y + f))) if p == last else None
            if u:
                gap = [m - n for m, n in zip(u[:3], v[:3])]
                gaps.append(max(abs(sum(m * n for m, n in zip(gap, w[3:]))) for w in (u, v)) if normal else math.hypot(*gap))
        if gaps:
            want.append((first, k, last, len(gaps), round(max(gaps), 9)))
    table = spark.createDataFrame([(*w[:3], w[0], w[2], *w[3:]) for w in walks], "v0 long, v1 long, v2 long, first long, last long, a double, b double, c double, d double, e double, f double")
    got = compared_ends(table, df, ["v0", "v1", "v2"], normal, block, piece)
    assert sorted(((*tuple(r)[:4], round(r.worst, 9)) for r in got.collect()), key=repr) == sorted(want, key=repr) and 20 < len(want) < 60
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()  # points of walks were joined and shuffled as rows


def test_no_walks(spark):
    none = spark.createDataFrame([], "v0 long, first long, last long, a double, b double, c double, d double, e double, f double")
    assert compared_ends(none, spark.createDataFrame([(1, 0, 0, 0, 0, 0)], NAMES), ["v0"], True).count() == 0
