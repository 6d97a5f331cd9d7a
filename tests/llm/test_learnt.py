import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import sentence
from lamina.llm import quality_classifier as qc
from lamina.llm import toxicity as tox


def brute_segments(values):
    """All maximal scoring segments by the recursive definition."""

    def go(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                v = sum(values[i:j])
                if v > 1e-9 and (best is None or (v, -(j - i)) > (best[0] + 1e-9, -(best[2] - best[1]))):
                    best = (v, i, j)
        if best is None:
            return []
        v, i, j = best
        return go(lo, i) + [(i, j - 1)] + go(j, hi)

    return go(0, len(values))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 3.3, 5.7, 9.1, 1.9]), max_size=12))
def test_segments_are_all_maximal_ones(scores):
    at = np.flatnonzero(scores)
    got = tox.maximal_segments(at, np.array(scores)[at], 1.27)
    values = [s if s else -1.27 for s in scores]
    assert [(a, b) for a, b, _ in got] == brute_segments(values)
    for a, b, v in got:
        assert abs(v - sum(values[a : b + 1])) < 1e-9


def toxic_corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = sentence(rng, rng.randint(20, 120), 500).split()
        bad = i % 5 == 1
        if bad:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "nasty", "awful,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_fold(spark):
    rows, labels = toxic_corpus()
    rows += [(None, "vile nasty awful"), (5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "segments": F.lit(1)})
    out = tox.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id in (5000, 5001)} == {0}


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in tox.toxicity(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flip))
    assert a == b


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in tox.toxicity(df, none).collect()] == [0]
    assert tox.toxicity(df.where("false"), none).count() == 0


def test_grades_in_order(spark):
    rng = random.Random(5)
    rows, grades = [], []
    for i in range(600):
        g = i % 3
        words = [f"g{g}w{rng.randrange(40)}" if rng.random() < 0.4 else f"c{rng.randrange(200)}" for _ in range(rng.randint(10, 60))]
        rows.append((i, " ".join(words)))
        if i % 2:
            grades.append((i, g))
    rows += [(None, "g2w1 g2w2 g2w3"), (7000, None), (7001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", F.lit("clash"))
    out = qc.quality_grades(df, spark.createDataFrame(grades, "doc_id long, grade int")).collect()
    assert len(out) == len(rows)
    held = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 2 == 0}
    assert np.mean([round(r.expected_grade) == i % 3 for i, r in held.items()]) > 0.9
    assert np.mean([r.kept == (i % 3 >= 1) for i, r in held.items()]) > 0.95
    assert not any(r.kept for r in out if r.doc_id in (7000, 7001))


def test_likelihood_and_gradient():
    """The loss equals a plain sum over texts, and its gradient finite differences, for two, three and four grades."""
    rng = np.random.default_rng(3)
    for grades in (2, 3, 4):
        n, size = 40, 12
        row = np.repeat(np.arange(n), 4)
        idx, val = rng.integers(0, size, 4 * n), rng.random(4 * n)
        y, balance = rng.integers(0, grades, n), rng.random(n) + 0.5
        w, free = rng.standard_normal(size), rng.standard_normal(grades - 1)
        loss, gw, gfree = qc.loss_and_gradient(w, free, idx, val, row, y, balance)
        cuts = [free[0]]
        for g in free[1:]:
            cuts.append(cuts[-1] + math.exp(g))
        total = 0.0
        for i in range(n):
            f = sum(w[idx[k]] * val[k] for k in range(4 * n) if row[k] == i)
            below = lambda j: 0.0 if j < 0 else 1.0 if j >= grades - 1 else 1 / (1 + math.exp(f - cuts[j]))  # noqa: B023, E731
            total -= balance[i] * math.log(below(y[i]) - below(y[i] - 1))
        assert abs(loss - total / n - qc.RIDGE / 2 * (w @ w)) < 1e-9
        for x, g in ((w, gw), (free, gfree)):
            for i in range(len(x)):
                keep, step = x[i], 1e-6
                x[i] = keep + step
                up = qc.loss_and_gradient(w, free, idx, val, row, y, balance)[0]
                x[i] = keep - step
                down = qc.loss_and_gradient(w, free, idx, val, row, y, balance)[0]
                x[i] = keep
                assert abs((up - down) / (2 * step) - g[i]) < 1e-6


def test_score_equals_plain_arithmetic(spark):
    """Term scores, lambda, K, evidence and the final score, each again from its definition, one text at a time; ties, repeated rows and a long text too."""
    import pyarrow as pa

    from lamina.llm.words import slices

    rows, labels = toxic_corpus()
    rows += rows[:4] + [(6000, "x " * 40_000 + "nasty"), (6001, "nasty"), (6002, "nasty")]
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.learn_terms(docs, rated, "doc_id", "text")
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    seen, words_of = [], []
    for i, text in rows:
        (s,) = slices(pa.array([text]))
        each = [{} for _ in range(len(s.start))]
        for kind, (at, h) in enumerate(tox.tokens(s)):
            for k, x in zip(at.tolist(), h.tolist()):
                each[k][kind] = x
        words_of.append(each)
        seen.append({x for w in each for x in w.values()})
    n_all = len(rows)
    toxic = [k for k, (i, _) in enumerate(rows) if truth.get(i) == 1]
    other = [k for k, (i, _) in enumerate(rows) if truth.get(i) == 0]
    count = lambda part, x: sum(x in seen[k] for k in part)
    score, rate = {}, {}
    n_words = sum(len(words_of[k]) for k in other)
    for x in set().union(*(seen[k] for k in toxic)):
        t, o, every = count(toxic, x), count(other, x), count(range(n_all), x)
        if t < tox.MIN_COUNT:
            continue
        a = every * tox.PRIOR_DOCS / n_all + tox.PRIOR_BASE
        odds = lambda y, n: math.log((y + a) / (n + tox.PRIOR_DOCS - y))  # noqa: B023, E731
        low = odds(t, len(toxic)) - odds(o, len(other)) - tox.CONFIDENCE * math.sqrt(1 / (t + a) + 1 / (o + a))
        if low > 0:
            score[x], rate[x] = low, o / n_words + 1e-9
    assert dict(zip(model.token.tolist(), model.score.round(9).tolist())) == {x: round(v, 9) for x, v in score.items()}
    moment = sum(rate[x] * math.exp(model.lam * v) for x, v in score.items()) + (1 - sum(rate.values())) * math.exp(-model.lam * tox.DRIFT)
    assert abs(moment - 1) < 1e-6 and model.lam > 1e-3
    segments = []
    for each in words_of:
        values = [max((score[x] for x in w.values() if x in score), default=0.0) for w in each]
        at = np.flatnonzero(values)
        segments.append([v for _, _, v in tox.maximal_segments(at, np.array(values)[at], tox.DRIFT)])
    s0 = float(np.median(list(score.values())))
    k = (sum(v >= s0 for d in other for v in segments[d]) + 0.5) / (n_words * math.exp(-model.lam * s0))
    best, total = [], []
    for each, found in zip(words_of, segments):
        e = [model.lam * v - math.log(k * len(each)) for v in found]
        best.append(min(max([0.0, *e]), 40.0))
        total.append(min(sum(max(x, 0.0) for x in e), 80.0))
    half_up = lambda v: math.floor(v + 0.5)
    x = np.array([[half_up(2 * best[d]) / 2, half_up(total[d])] for d in (*toxic, *other)])
    b = tox._logistic(x, np.array([1.0] * len(toxic) + [0.0] * len(other)), np.ones(len(x)))
    want = [1 / (1 + math.exp(-(b[0] + b[1] * best[d] + b[2] * total[d]))) for d in range(n_all)]
    got = sorted((r.doc_id, round(r.score, 6)) for r in tox.toxicity(docs, rated).collect())
    assert got == sorted((i, round(v, 6)) for (i, _), v in zip(rows, want))


def test_one_grade_or_none(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (None, 2), (2, None)], "doc_id long, grade int")
    assert {(r.doc_id, r.kept, r.p_tail) for r in qc.quality_grades(df, one).collect()} == {(1, True, None), (2, False, None)}
    assert qc.quality_grades(df.where("false"), one).count() == 0


def test_outer_punctuation_of_any_length():
    import pyarrow as pa

    from lamina.llm.words import slices

    text = '((((("word"))))))))) -- ' + "=" * 3000 + " a... é!!!! ?x"
    (s,) = slices(pa.array([text]))
    start, end = tox._trimmed(s)
    assert [bytes(s.buf[a:b]).decode() for a, b in zip(start, end)] == ["word", "-", "=", "a", "é", "x"]
