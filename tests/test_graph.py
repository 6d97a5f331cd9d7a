"""Graph operators against plain Python."""

import heapq
import random

from lamina.operators import graph as G
from lamina.operators import walks as W
from lamina.operators import relax
from lamina.plans.voxels import label_voxels


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def visited(edges):
    """{(component, ord, id)} by one queue."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = set(), set()
    for root in sorted(near):
        if root in seen:
            continue
        heap, ord_ = [root], 0
        seen.add(root)
        while heap:
            v = heapq.heappop(heap)
            ord_ += 1
            want.add((root, ord_, v))
            for t in near[v] - seen:
                seen.add(t)
                heapq.heappush(heap, t)
    return want


def test_visit_order(spark):
    """Several components, loops, repeated edges and long chains of falling numbers."""
    edges = random_edges(1, 12, 12) + [(100, 140), (140, 139), (139, 150), (150, 101), (7, 7), (140, 100)]
    want = visited(edges)
    got = G.visit_order(spark.createDataFrame(edges, "p1 long, p2 long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_visit_order_on_chains(spark, monkeypatch):
    """A chain of 300 falling numbers, one with a ring and a fork at its end, and a ring: few rounds, whatever the length."""
    falling = [(0, 1000), *((k, k - 1) for k in range(1000, 700, -1))]
    forked = [(2000, 3000), *((k, k - 1) for k in range(3000, 2900, -1)), (2900, 2500), (2900, 3500), (2500, 3501), (3501, 2501), (2501, 3500)]
    ring = [(4000, 4005), (4005, 4003), (4003, 4004), (4004, 4000)]
    edges = falling + forked + ring
    rounds = []
    runs = G.forced_runs
    monkeypatch.setattr(G, "forced_runs", lambda *a: rounds.append(1) or runs(*a))
    got = G.visit_order(spark.createDataFrame(edges, "p1 long, p2 long")).collect()
    want = visited(edges)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(rounds) < 8


def least_reachable(pairs):
    """{id: least id reachable}, by union-find."""
    up = {}

    def find(v):
        up.setdefault(v, v)
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {v: find(v) for v in up}


def test_components(spark):
    """Random graphs, a long chain in falling and in mixed order, loops and repeated edges; no edges, no rows."""
    chain = list(range(1000, 1060))
    random.Random(3).shuffle(chain)
    edges = random_edges(4, 60, 40) + list(zip(chain, chain[1:])) + [(k + 1, k) for k in range(2000, 2040)] + [(5, 5), (2000, 2001)]
    got = G.components(spark.createDataFrame(edges, "p1 long, p2 long")).collect()
    want = least_reachable([e for e in edges if e[0] != e[1]])
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert G.components(spark.createDataFrame([], "p1 long, p2 long")).count() == 0


def test_label_voxels(spark, tmp_path):
    """The query's regions against a flood fill, beyond any former range of slices."""
    rng = random.Random(5)
    grid = {z: [rng.uniform(-0.03, 0.06) for _ in range(64)] for z in range(120)}
    spark.createDataFrame(list(grid.items()), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    on = {64 * z + i for z, e in grid.items() for i, v in enumerate(e) if v > 0.02}
    near = [(v, v + s) for v in on for s, inside in ((1, v % 8 < 7), (8, v // 8 % 8 < 7), (64, True)) if inside and v + s in on]
    label = least_reachable([*near, *((v, v) for v in on)])
    want = {}
    for v, c in label.items():
        n, lo, hi = want.get(c, (0, v // 64, v // 64))
        want[c] = (n + 1, min(lo, v // 64), max(hi, v // 64))
    got = label_voxels(spark, str(tmp_path)).collect()
    assert {r.label: (r.volume, r.z0, r.z1) for r in got} == want and len(got) == len(want)


def test_hitting_set(spark):
    edges = [(a, b) for a, b in random_edges(2, 9, 14) if a != b]
    left, want = {tuple(sorted(e)) for e in edges}, []
    while left:
        count = {}
        for e in left:
            for v in e:
                count[v] = count.get(v, 0) + 1
        top = min(count, key=lambda v: (-count[v], v))
        want.append(top)
        left = {e for e in left if top not in e}
    pairs = spark.createDataFrame(sorted({tuple(sorted(e)) for e in edges}), "a long, b long")
    got = {r["round"]: r["id"] for r in W.hitting_set(pairs).collect()}
    assert [got[k] for k in sorted(got)] == want


def test_placement(spark):
    """A chain of quarter turns comes back to its start; of two neighbours of one level the one of larger weight places."""
    turn = (0.0, -1.0, 2.0, 1.0, 0.0, 0.0)
    rows = [(p, p + 1, 1, *turn) for p in range(4)] + [(0, 9, 1, *turn), (1, 8, 1, *turn), (9, 8, 5, *turn)]
    rel = spark.createDataFrame(rows, "p1 long, p2 long, w long, a double, b double, c double, d double, e double, f double")
    got = {r.p: r for r in relax.place(rel, spark.createDataFrame([(0,)], "id long")).collect()}
    assert {p: r.level for p, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 1, 8: 2}
    assert got[8].from_p == 9 and (got[4].a, got[4].b, got[4].c, got[4].d, got[4].e, got[4].f) == (1, 0, 0, 0, 1, 0)
