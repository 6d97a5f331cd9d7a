"""Cage, connected orders, walks, removal and paths against plain Python."""

import heapq
import math
import random

import pytest

from lamina.operators import cage, spanning
from lamina.operators import graph as G
from lamina.operators import walks as W

TX = "p1 long, p2 long, a double, b double, c double, d double, e double, f double"


def test_cage(spark):
    """Overlapping triangles of both turns, one without area, points on edges and corners and outside."""
    rng = random.Random(3)
    triangles = []
    for tri in range(25):
        corners = [rng.randint(-40, 40) for _ in range(6)]
        if tri == 4:
            corners = [0, 0, 10, 10, 20, 20]
        triangles.append((tri, *corners, *(c + rng.randint(-3, 3) for c in corners)))
    points = [(i, rng.randint(-45, 45), rng.randint(-45, 45)) for i in range(400)] + [(1000 + i, t[1], t[2]) for i, t in enumerate(triangles)]

    def turn(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    want = {}
    for i, x, y in points:
        want[i] = None
        for tri, ax, ay, bx, by, cx, cy, *m in triangles:
            area = turn(ax, ay, bx, by, cx, cy)
            t = [turn(ax, ay, bx, by, x, y), turn(bx, by, cx, cy, x, y), turn(cx, cy, ax, ay, x, y)]
            if area and (min(t) >= 0 or max(t) <= 0):
                k, l = turn(ax, ay, x, y, cx, cy) / area, turn(ax, ay, bx, by, x, y) / area
                want[i] = tri, m[0] + k * (m[2] - m[0]) + l * (m[4] - m[0]), m[1] + k * (m[3] - m[1]) + l * (m[5] - m[1])
                break
    names = "tri long, ax long, ay long, bx long, by long, cx long, cy long, max long, may long, mbx long, mby long, mcx long, mcy long"
    got = cage.deform(spark.createDataFrame(points, "id long, x long, y long"), ["id"], spark.createDataFrame(triangles, names), 16).collect()
    assert len(got) == len(points) and any(w is None for w in want.values())
    for r in got:
        w = want[r.id]
        assert (r.tri, r.u, r.v) == (None, None, None) if w is None else r.tri == w[0] and math.isclose(r.u, w[1], abs_tol=1e-9) and math.isclose(r.v, w[2], abs_tol=1e-9)


def prim(edges):
    draw, near = {}, {}
    for a, b in edges:
        if a != b:
            p, q = min(a, b), max(a, b)
            draw[p, q] = (p * 7919 + q * 104729 + p * q * 31) % 1000003, p, q
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, seen = {}, set()
    for root in sorted(near):
        if root in seen:
            continue
        heap, place = [((-1,), None, root)], 0
        while heap:
            _, parent, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            place += 1
            out[v] = root, place, parent
            for u in near[v] - seen:
                heapq.heappush(heap, (draw[min(u, v), max(u, v)], v, u))
    return out


@pytest.mark.parametrize("edges", [
    [(0, k) for k in range(1, 14)] + [(50, 50), (60, 61)],
    [(k, k + 1) for k in range(20)] + [(3, 3)],
    sorted({(a * 7 % 23, (a * a + 3) % 23) for a in range(60)} | {(100 + a % 7, 100 + a * 3 % 11) for a in range(15)}),
    [],
])
def test_growth_order(spark, edges):
    """Star, path, random graph of two components, no edges: the order in which one queue would take the vertices, with parents."""
    df = spark.createDataFrame(edges, "p1 long, p2 long")
    assert {r.id: (r.component, r.ord, r.parent) for r in spanning.growth_order(df).collect()} == prim(edges)


def relation_rows(seed, n, m):
    rng = random.Random(seed)
    rows = {}
    for _ in range(m):
        t = rng.choice([0, math.pi / 2, math.pi, -math.pi / 2])
        rows[rng.randrange(n), rng.randrange(n)] = (round(math.cos(t)), -round(math.sin(t)), float(rng.randint(-2, 2)), round(math.sin(t)), round(math.cos(t)), float(rng.randint(-2, 2)))
    return [(*k, *map(float, v)) for k, v in sorted(rows.items())]


def compose(m, n):
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f


def test_walks_without_revisits(spark):
    rows = relation_rows(4, 15, 30)
    near = {}
    for p, q, *t in rows:
        if p != q:
            near.setdefault(p, {})[q] = tuple(t)
    for p, q, *t in rows:
        if p != q and p not in near.get(q, {}):
            a, b, c, d, e, f = t
            near.setdefault(q, {})[p] = a, d, -(a * c + d * f), b, e, -(b * c + e * f)
    banned, want = {3, 8}, []
    for start in [0, 1, 2, 3, 7, 99]:
        path, frame = [start], (1, 0, 0, 0, 1, 0)
        want.append((start, 0, start, *frame))
        while len(path) < 6:
            free = [v for v in near.get(path[-1], {}) if v not in path and v not in banned] if path[-1] not in banned else []
            if not free:
                break
            nxt = min(free, key=lambda v: ((start * 7919 + v * 104729 + len(path) * 1299709) % 1000003, v))
            frame = compose(frame, near[path[-1]][nxt])
            path.append(nxt)
            want.append((start, len(path) - 1, nxt, *frame))
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "id long")
    got = W.self_avoiding_walks(spark.createDataFrame(rows, TX), ids([0, 1, 2, 3, 7, 99]), 6, ids(sorted(banned))).collect()
    assert sorted((r.walk, r.step, r.id, *(round(r[c], 6) + 0 for c in "abcdef")) for r in got) == sorted((*w[:3], *(round(float(x), 6) + 0 for x in w[3:])) for w in want)


def sequential(tuples):
    left, gone = list(tuples), []
    while left:
        count = {}
        for t in left:
            for v in t:
                count[v] = count.get(v, 0) + 1
        top = min(count, key=lambda v: (-count[v], v))
        gone.append((top, count[top]))
        left = [t for t in left if top not in t]
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_removal_goes_as_one_by_one(spark, seed):
    """Walks of several lengths, some through a patch twice, some repeated."""
    rng = random.Random(seed)
    tuples = [tuple(rng.randrange(30) for _ in range(rng.randint(2, 5))) for _ in range(80)] + [(1, 1), (1, 1), (2, 3), (2, 3)]
    got = W.greedy_removal(spark.createDataFrame([(list(t),) for t in tuples], "members array<long>")).collect()
    assert sorted((r.id, r.n) for r in got) == sorted(sequential(tuples))
    order = [r.id for r in sorted(got, key=lambda r: (-r.n, r.id))]
    assert order == [v for v, _ in sequential(tuples)]


def test_rounds_do_not_grow_with_the_number_of_bad_patches(spark):
    pairs = [(10 * k, 10 * k + j) for k in range(200) for j in (1, 2, 3)]
    got = W.greedy_removal(spark.createDataFrame([(list(p),) for p in pairs], "members array<long>")).collect()
    assert {(r.id, r.round) for r in got} == {(10 * k, 1) for k in range(200)}
    assert W.greedy_removal(spark.createDataFrame([], "members array<long>")).count() == 0


def test_bad_patches_over_chained_lengths(spark):
    """Flat patches on one plane; patch 4 stands apart and patch 7 turns a frame, which only longer walks show."""
    points = [(p, x, y, 4.0 * x, 4.0 * y, 30.0 if p == 4 else 3.0 * p) for p in range(9) for x in range(-3, 4) for y in range(-3, 4)]
    rows = [(p, q, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for p in range(9) for q in (p - 1, p + 1) if 0 <= q < 9]
    got, scores = W.bad_patches(spark.createDataFrame(rows, TX), spark.createDataFrame(points, "pid long, qx long, qy long, vx double, vy double, vz double"), (2, 3, 4), 7.0)
    height = {p: 30.0 if p == 4 else 3.0 * p for p in range(9)}
    near = {p: [q for q in (p - 1, p + 1) if 0 <= q < 9] for p in range(9)}
    bad, want, all_scores = set(), [], []
    for length in (2, 3, 4):
        walks = [[p] for p in range(9) if p not in bad]
        for _ in range(length - 1):
            walks = [w + [q] for w in walks for q in near[w[-1]] if q not in bad]
        all_scores += [(w[0], w[-1], length, abs(height[w[0]] - height[w[-1]])) for w in walks]
        gone = sequential([w for w in walks if abs(height[w[0]] - height[w[-1]]) > 7.0 * (length - 1)])
        want += [(v, length, n) for v, n in gone]
        bad |= {v for v, _ in gone}
    assert sorted((r.id, r.length, r.n) for r in got.collect()) == sorted(want) and want
    assert sorted((r.first, r.last, r.length, r.worst) for r in scores.collect()) == sorted(all_scores)


def test_paths(spark):
    """A chain of 40 and side ways; unreached vertices have no row."""
    rng = random.Random(9)
    edges = [(k, k + 1, 1) for k in range(40)] + [(rng.randrange(40), rng.randrange(40), rng.randint(3, 30)) for _ in range(20)] + [(90, 91, 1)]
    best = G.saved(G.shortest_paths(spark.createDataFrame(edges, "p1 long, p2 long, w long").where("p1 <> p2"), spark.createDataFrame([(0,)], "id long")))
    cost = {}
    for a, b, w in edges:
        cost[a, b] = cost[b, a] = min(w, cost.get((a, b), w))
    rows = {r.id: r for r in best.join(W.paths(best), "id").collect()}
    assert set(rows) == set(range(41))
    for v, r in rows.items():
        assert r.path[0] == 0 and r.path[-1] == v and len(r.path) == r.hops + 1
        assert sum(cost[a, b] for a, b in zip(r.path, r.path[1:])) == r.cost


@pytest.mark.parametrize("seed", [1, 2])
def test_bad_bridges_go_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)}
    near = sorted({(a, b) for e in edges for a, b in (e, e[::-1])})
    place = {v: (rng.uniform(0, 60), rng.uniform(0, 60), float(rng.randint(2, 8))) for v in range(25)}
    of = {}
    for a, b in near:
        of.setdefault(a, set()).add(b)
    bridges = [(c, a, b) for c in of for a in of[c] for b in of[c] if a < b and math.dist(place[a][:2], place[b][:2]) > 2 * place[c][2] + place[a][2] + place[b][2]]
    left, want = list(bridges), []
    while left:
        count = {}
        for c, _, _ in left:
            count[c] = count.get(c, 0) + 1
        top = min(count, key=lambda v: (-count[v], v))
        want.append((top, count[top]))
        left = [t for t in left if top not in t]
    found = W.implausible_bridges(spark.createDataFrame(near, "src long, dst long"), spark.createDataFrame([(v, *p) for v, p in place.items()], "id long, x double, y double, radius double"))
    assert sorted(map(tuple, found.collect())) == sorted(bridges)
    got = W.bad_bridges(found).collect()
    assert sorted((r.id, r.n) for r in got) == sorted(want) and max(r.round for r in got) < len(want)
