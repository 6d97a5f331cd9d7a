import hashlib
import zlib
from collections import defaultdict

import numpy as np

from lamina.llm import prefix_trie as T
from lamina.llm.queries import QUERIES, SQL

from oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, pos string, key long"


def exact(rows):
    """Every prefix with the members, children, leaves and savings that its definition gives."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(full.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children[p]
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], sha([c for c in members[p] if full[c] == p])) for p in members
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in T.prefix_trie(T.rebuilt(df)).collect()), key=lambda r: (r[0], r[1], r[2] or 0, r))


def key(r):
    return r[0], r[1], r[2] or 0, r


def check(spark, rows):
    got, want = found(spark, rows), sorted(exact(rows), key=key)
    assert got == want


def test_random_conversations_over_many_parts(spark, monkeypatch):
    """Few words, so that prefixes branch everywhere; many copies of one conversation, so that its members cross parts."""
    monkeypatch.setattr(T, "PART_TURNS", 60)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(300):
        turns = [0, 1, 1, 0, 1, 1, 0] if c % 3 == 0 else rng.integers(0, 2, rng.integers(1, 12))
        rows += [(c * 7 % 1009, t, ["user", "assistant"][t % 2], f"{'é' * int(w)}w{w}") for t, w in enumerate(turns)]
    check(spark, rows)


def test_edges(spark):
    long = [(900, t, "user", f"turn {t}") for t in range(2000)] + [(901, t, "user", f"turn {t}") for t in range(1500)]
    odd = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (1, 3, "a", ""), (1, 3, "", "a"), (5, 2, "user", "y" * 200_000), (-7, 1, "user", "z"), (-107, 1, "user", "z"), (250, 9, "user", "only")]
    check(spark, long + odd)
    check(spark, [(c, 0, "user", "same") for c in range(0, 40_000, 100)])
    check(spark, [(101, 1, "user", "lost")])
    assert found(spark, []) == []


def test_members_are_found_on_both_sides():
    values = np.random.default_rng(2).integers(0, 5, 61)
    table = T.RangeMin(values)
    at, bound = np.repeat(np.arange(61), 6), np.tile(np.arange(6), 61)
    for i, b, lo, hi in zip(at, bound, table.left(at, bound), table.right(at, bound)):
        r = i
        while r + 1 < 61 and values[r + 1] >= b:
            r += 1
        l = i
        while l > 0 and values[l] >= b:
            l -= 1
        assert (lo, hi) == (l, r)
    lo, hi = np.arange(60), np.minimum(61, np.arange(60) * 2 + 1)
    assert [int(x) for x in table.least(lo, hi)] == [int(values[a:b].min()) for a, b in zip(lo, hi)]


def test_query_equals_sql(spark):
    assert compare(spark, QUERIES["op13_prefix_trie"], SQL["op13_prefix_trie"], "/root/testdata/sf0.001") > 0
