import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import sentence
from lamina.llm import decontamination as dc


def distance(a, b):
    """Least edits of a to any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_edit_distance(a, b):
    d, lo, hi = dc.edit_distance(np.array(a), np.array(b, np.int64))
    assert d == distance(a, b) and 0 <= lo <= hi <= len(b)
    assert dc.missing(np.array(a), np.array(b, np.int64)) == sum(x not in b for x in a) <= d


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[k] = f"new{rng.random()}"
        elif kind == 1:
            w.insert(k, f"new{rng.random()}")
        elif len(w) > 1:
            del w[k]
    return w


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(8)
    items = [sentence(rng, rng.randint(15, 50), 3000) for _ in range(40)]
    docs, planted = [], []
    for i in range(160):
        w = sentence(rng, 120, 3000).split()
        if i % 2 == 0:
            k = rng.randrange(len(items))
            own = items[k].split()
            edits = rng.randint(0, len(own) // 10)
            at = rng.randrange(len(w))
            w = w[:at] + edited(rng, own, edits) + w[at:]
            planted.append((i, k))
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[0]), (902, items[1].upper()), (902, items[1].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as keys", "2 as item_id")
    bench = spark.createDataFrame([*enumerate(items), (70, None), (71, "one two"), (None, "x y z w v")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(df, bench).collect()}
    of = dict(d for d in docs if d[0] is not None)
    for (i, k), e in got.items():  # every row is right
        a, b = items[k].lower().split(), of[i].lower().split()
        assert distance(a, b) <= e <= dc.allowed(len(a))
    found = sum(p in got for p in planted)
    assert found >= 0.98 * len(planted), (found, len(planted))
    assert (902, 1) in got and not {i for i, _ in got} & {900, 901}
    assert len(set(got) - set(planted) - {(902, 1)}) <= 2


def test_recall_at_the_limit(spark):
    """Items of 20 to 300 words, each edited by the whole 20 %."""
    rng = random.Random(31)
    lengths, copies = (20, 59, 120, 250, 300), 10
    items, docs = [], []
    for n in range(len(lengths) * copies):
        w = sentence(rng, lengths[n // copies], 10**6).split()
        items.append((n, " ".join(w)))
        docs.append((n, " ".join([sentence(rng, rng.randint(20, 60), 10**6), *edited(rng, w, dc.allowed(len(w))), sentence(rng, 40, 10**6)])))
    got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = [sum((n, n) in got for n in range(i * copies, (i + 1) * copies)) / copies for i in range(len(lengths))]
    assert min(recall) >= 0.9 and sum(recall) / len(recall) >= 0.96, recall


def test_pairs_needed_is_a_bound():
    rng = random.Random(2)
    for m in range(4, 120):
        size = int(dc.size_class(m))
        for _ in range(20):
            w = [f"a{i}" for i in range(m)]
            v = edited(rng, w, dc.allowed(m))[:size]
            assert len(set(zip(w, w[1:])) & set(zip(v, v[1:]))) >= dc.pairs_needed(size, m, m, 20)
    assert dc.pairs_needed(10, 9, 10, 20) == 5 and dc.pairs_needed(40, 38, 42, 20) == 23


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert dc.leaks(df.where("false"), bench).count() == 0
    assert dc.leaks(df, bench.where("false")).count() == 0
    assert [tuple(r) for r in dc.leaks(df, bench).collect()] == [(1, 1, 0, 1)]
    assert dc.clean_documents(df, bench).count() == 0


def test_rows_are_the_same_without_a_broadcast(spark, monkeypatch):
    """Items beyond the bound of the broadcast; repeated documents, one text that holds an item twice, and two items alike."""
    rng = random.Random(12)
    items = [sentence(rng, 20, 500) for _ in range(12)]
    items.append(items[0])
    docs = [(i, f"{sentence(rng, 30, 500)} {items[i % 12]} {sentence(rng, 9, 500)}") for i in range(24)]
    docs += [docs[0], (50, f"{items[3]} and {items[3]}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    near = sorted(map(tuple, dc.contaminated_spans(df, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_HASHES", 0)
    far = dc.contaminated_spans(df, bench)
    assert sorted(map(tuple, far.collect())) == near and len(near) == len(set(near))
    want = {(i, i % 12) for i in range(24)} | {(i, 12) for i in range(0, 24, 12)} | {(50, 3)}
    assert {(d, item) for d, item, *_ in near} == want and len([r for r in near if r[0] == 50]) == 2
