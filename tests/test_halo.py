"""Wide stencils by blocks against loops over the whole volume."""

import random

import pytest

from lamina.operators import halo as H
from lamina.plans import registry

SIZE, LOW = (13, 9, 4), (100, -3, 7)


def volume(seed=1):
    rng = random.Random(seed)
    return {(z, y, x): rng.randint(0, 40) for z in range(SIZE[0]) for y in range(SIZE[1]) for x in range(SIZE[2]) if rng.random() < 0.9 or (z, y, x) in ((0, 0, 0), (12, 8, 3))}


def back(i, n, again):
    i = abs(i)
    if i >= n:
        i = 2 * n - i - (1 if again else 2)
    return max(0, min(n - 1, i))


def table(spark, vol):
    rows = [(*(p + l for p, l in zip(k, LOW)), v) for k, v in vol.items()] + [(103, 0, 8, None)]
    return spark.createDataFrame(rows + rows[:5], "z long, y long, x long, g long")


def found(df, names):
    rows = df.collect()
    out = {tuple(r[a] - l for a, l in zip("zyx", LOW)): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("side", [3, 8, 32])
def test_every_cut_gives_the_same(spark, side):
    vol = volume()
    df = table(spark, vol)

    want = {}
    for k, v in vol.items():
        lo = [max(0, min(c - 2, n - 5)) for c, n in zip(k, SIZE)]
        near = [u for p, u in vol.items() if all(l <= c < l + 5 for l, c in zip(lo, p))]
        want[k] = (min(255, 256 * sum(u <= v for u in near) // len(near)),)
    assert found(H.stencil(df, "g", "e", 2, H.equalised(2), side=side), ["e"]) == want

    full = {(z, y, x): vol.get((z, y, x), 0) for z in range(SIZE[0]) for y in range(SIZE[1]) for x in range(SIZE[2])}
    for axis in (2, 1, 0):
        new = {}
        for k in full:
            at = lambda o, k=k: tuple(back(c + o, SIZE[axis], True) if a == axis else c for a, c in enumerate(k))  # noqa: B023, E731
            new[k] = sum(w * full[at(o - 2)] for o, w in enumerate([1, 4, 6, 4, 1])) // 16
        full = new
    assert found(H.stencil(df, "g", "s", 2, H.gaussian_axes(5), side=side), ["s"]) == {k: (full[k],) for k in vol}

    want = {}
    for z, y, x in vol:
        near = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if vol.get(tuple(back(p + o, n, False) for p, o, n in zip((z, y, x), (a, b, c), SIZE)), 0) > 0]
        n = len(near)
        want[z, y, x] = n, sum((10 * sum(o[i] for o in near) // max(n, 1)) ** 2 for i in range(3))
    assert found(H.stencil(df, "g", "n", 2, H.flatness(2), {"n": "long", "d2": "long"}, side=side), ["n", "d2"]) == want


def test_empty_volume(spark):
    df = spark.createDataFrame([], "z long, y long, x long, g long")
    assert H.stencil(df, "g", "s", 2, H.gaussian_axes(5)).collect() == []


@pytest.mark.parametrize("side", [3, 32])
def test_nearest_of_another_value(spark, side):
    """Counts, distances and sums of offsets, with absent voxels; one in a corner of equal ones finds none."""
    vol = {k: 0 if k[0] > 8 else v // 20 for k, v in volume().items()}
    span = range(-2, 3)
    want = {}
    for k, v in vol.items():
        others = [(z * z + y * y + x * x, (z, y, x)) for z in span for y in span for x in span if vol.get((k[0] + z, k[1] + y, k[2] + x), v) != v]
        d2 = min(others)[0] if others else 0
        near = [o for e, o in others if e == d2]
        want[k] = v, len(near), d2, *(sum(o[i] for o in near) for i in range(3))
    assert any(not w[1] for w in want.values())
    got = H.stencil(table(spark, vol), "g", "d", 2, H.differing(2), H.DIFFERING, side=side)
    assert found(got, list(H.DIFFERING)) == want


def test_wide_stencils_copy_no_voxel_to_its_whole_stencil(spark):
    """They sent each voxel to 25 or 124 cells and joined these with the volume."""
    for name in ("local_equalisation", "nearest_differing", "direction_field", "quantised_field"):
        assert "Join" not in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


@pytest.mark.parametrize("side", [3, 32])
def test_rank_among(spark, side):
    """Among those of a flat square that are there."""
    vol = volume(4)
    square = [(z, 0, x) for z in range(-2, 3) for x in range(-2, 3)]
    want = {}
    for k, v in vol.items():
        near = [vol[p] for p in (tuple(a + b for a, b in zip(k, o)) for o in square) if p in vol]
        want[k] = (255 * sum(u <= v for u in near) // len(near),)
    assert found(H.stencil(table(spark, vol), "g", "e", 2, H.rank_among(square, 2), side=side), ["e"]) == want
