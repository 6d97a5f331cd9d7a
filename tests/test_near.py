"""Near points by tiles against loops over all pairs."""

import math
import random

import pytest

from lamina.operators import align, near


def mesh_rows(seed, patches, step):
    rng = random.Random(seed)
    return [(p, x, y, 4 * x + step * p + rng.randint(0, 2), 4 * y - 30 + rng.randint(0, 2), rng.randint(-2, 2) + 9 * (p % 2)) for p in range(patches) for x in range(-6, 7) for y in range(-6, 7) if rng.random() < 0.8]


def table(spark, rows):
    return spark.createDataFrame([*rows, (1, 0, 0, None, 1, 1), (None, 0, 0, 1, 1, 1)], "pid long, qx long, qy long, vx long, vy long, vz long").repartition(5)


def near_of(rows, radius):
    out = {}
    for a in rows:
        out[a[:3]] = [(math.dist(a[3:], b[3:]), *b) for b in rows if b[0] != a[0] and math.dist(a[3:], b[3:]) < radius]
    return out


@pytest.mark.parametrize(("wide", "crowded"), [(16, 1 << 18), (2, 1 << 18), (3, 60), (16, 0)])
def test_nearest_of_others(spark, wide, crowded):
    """Any cut into tiles, crowded ones cut again, gives the same; many ties, since coordinates are whole."""
    rows = mesh_rows(1, 5, 7)
    got = near.nearest_of_others(table(spark, rows), "pid", ["qx", "qy"], "vx vy vz", 8, 3, wide, crowded).collect()
    want = {(*k, *b[1:4], rank): b[0] for k, bs in near_of(rows, 8).items() for rank, b in enumerate(sorted(bs, key=lambda b: b[:4])[:3], 1)}
    assert {tuple(r)[:7]: r.dist for r in got} == want and len(got) == len(want)


def matched(rows):
    out = {}
    for (p, x0, y0), bs in near_of(rows, 8).items():
        here = next(r for r in rows if r[:3] == (p, x0, y0))
        for q in {b[1] for b in bs}:
            three = sorted((b[0], *b[2:4], *b[4:]) for b in bs if b[1] == q)[:3]
            if len(three) == 3:
                (_, xa, ya, *a), (_, xb, yb, *b), (_, xc, yc, *c) = three
                s, u = (sum((k - m) * (h - m) for k, m, h in zip(e, a, here[3:], strict=True)) / 16 for e in (b, c))
                if ((xa == xb and ya == yc and ya != yb and xa != xc) or (ya == yb and xa == xc and xa != xb and ya != yc)) and 0 <= s <= 1 and 0 <= u <= 1:
                    out[p, q, x0, y0] = xa + s * (xb - xa) + u * (xc - xa), ya + s * (yb - ya) + u * (yc - ya)
    return out


@pytest.mark.parametrize(("wide", "crowded"), [(16, 1 << 18), (3, 60)])
def test_surface_matches(spark, wide, crowded):
    """Over one table, and over two whose matches are those of one side only."""
    rows = mesh_rows(2, 4, 9)
    want = matched(rows)
    at = lambda df: {(r.p1, r.p2, r.x0, r.y0): (r.x1, r.y1) for r in df.collect()}
    points = table(spark, rows)
    assert at(align.surface_matches(points, wide=wide, crowded=crowded)) == want and len(want) > 50
    two = align.surface_matches(points.where("pid = 0"), points, wide=wide, crowded=crowded)
    assert at(two) == {k: v for k, v in want.items() if k[0] == 0}


def test_pairs_are_not_shuffled(spark):
    """The former plan copied each point to 27 cells and dealt all pairs out again: here pieces bound the pairs that are held, whatever is crowded."""
    import numpy as np

    at = [np.zeros(300, np.int64)] * 3
    pieces = list(near.close(at, np.arange(300), np.arange(300), 8.0, piece=1000))
    assert sum(len(i) for i, _, _ in pieces) == 300 * 300 and max(len(i) for i, _, _ in pieces) <= 1000
    plan = align.surface_matches(table(spark, mesh_rows(3, 2, 9)))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan
