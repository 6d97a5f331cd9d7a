import random

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from helpers import sentence
from lamina.llm import substring as s


def score(x, y, i, j):
    return s.GAP * ((x[i] - x[j]) + (y[i] - y[j]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=14, unique=True))
def test_best_chain_equals_quadratic_search(points):
    x, y = (np.array(v, np.int64) for v in zip(*points))
    found = s.chains(x, y)
    assert sorted(i for c in found for i in c) == list(range(len(points)))
    for c in found:
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    best = {}
    for i in order:
        best[i] = s.K + max([0.0] + [best[j] - score(x, y, i, j) for j in best if x[j] < x[i] and y[j] < y[i]])
    total = max(sum(s.K for _ in c) - sum(score(x, y, b, a) for a, b in zip(c, c[1:])) for c in found)
    assert abs(total - max(best.values())) < 1e-9


def test_planted_passages(spark):
    rng = random.Random(4)
    passage = sentence(rng, 60, 10**6)
    fuzzy = passage.split()
    fuzzy[30] = "changed"
    fuzzy = " ".join(fuzzy[:15] + ["extra"] + fuzzy[15:])
    clean = {i: sentence(rng, 150, 10**6) for i in range(30)}
    docs = dict(clean)
    docs[3] = sentence(rng, 20, 10**6) + "\n" + passage + " " + sentence(rng, 20, 10**6)
    docs[9] = sentence(rng, 33, 10**6) + "  " + passage.upper()
    docs[12] = fuzzy + " " + sentence(rng, 50, 10**6)
    docs[20] = passage
    rows = [*docs.items(), (None, passage), (40, None), (41, "too short"), (42, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as anchor", "doc_id as id")
    got = {(r.doc_id, r.is_first): r for r in s.repeated_passages(df).collect()}
    assert set(got) == {(3, True), (9, False), (12, False), (20, False)}
    assert (got[9, False].start_word, got[9, False].end_word, got[9, False].edits) == (33, 93, 0)
    assert got[12, False].edits >= 2 and got[12, False].n_words >= 58
    left = {r.doc_id: r.text for r in s.without_passages(df.select("doc_id", "text", "anchor")).collect()}
    assert 20 not in left and 42 in left and left[3] == docs[3] and left[0] == docs[0]
    assert left[9] == " ".join(docs[9].split()[:33]) + "  " and "changed" not in left[12]


def test_recall_of_edited_passages(spark):
    """Passages of 55 to 80 words with changed words, many of them with one seed left."""
    rng = random.Random(21)
    rates, copies = (8, 10, 15), 120
    rows = []
    for n, (rate, _) in enumerate((r, c) for r in rates for c in range(copies)):
        w = sentence(rng, rng.randint(55, 80), 10**6).split()
        v = list(w)
        for i in rng.sample(range(len(w)), round(len(w) * rate / 100)):
            v[i] = f"new{rng.randrange(10**9)}"
        for m, part in enumerate((w, v)):
            rows.append((2 * n + m, " ".join([sentence(rng, 60, 10**6), *part, sentence(rng, 60, 10**6)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id // 2 for r in s.repeated_passages(df, first=False).collect() if r.source_id == r.doc_id - 1}
    recall = [sum(n in got for n in range(i * copies, (i + 1) * copies)) / copies for i in range(len(rates))]
    assert recall[0] >= 0.98 and recall[1] >= 0.97 and recall[2] >= 0.85, recall


def test_copies_of_one_text(spark):
    t = sentence(random.Random(1), 80, 10**6)
    df = spark.createDataFrame([(i, t) for i in range(40)], "doc_id long, text string")
    rows = s.repeated_passages(df, first=False).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.source_id) for r in rows) == [(i, 0, 80, 0) for i in range(1, 40)]
    assert s.without_passages(df).count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.repeated_passages(df).count() == 0 and s.without_passages(df).count() == 0


def test_common_phrases_hide_no_passage(spark):
    """Each 6-gram of a shared passage also stands in 25 other texts, before and between the two."""
    rng = random.Random(6)
    passage = sentence(rng, 120, 10**6).split()
    grams = [passage[i : i + 6] for i in range(115)] * 25
    rng.shuffle(grams)
    around = lambda n: sentence(rng, n, 10**6)
    rows = [(i, " ".join([around(10), *(" ".join(g) + " " + around(8) for g in grams[5 * i : 5 * i + 5])])) for i in range(575)]
    rows = [(i if i < 300 else i + 1, t) for i, t in rows] + [(300, f"{around(30)} {' '.join(passage)} {around(30)}"), (900, f"{around(40)} {' '.join(passage)}")]
    got = s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), first=False).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_id, r.edits) for r in got] == [(900, 40, 160, 300, 0)]


def test_pieces_of_different_texts_are_no_passage(spark):
    rng = random.Random(7)
    t = sentence(rng, 120, 10**6).split()
    rows = [(i, f"{sentence(rng, 50, 10**6)} {' '.join(t[20 * i : 20 * i + 20])} {sentence(rng, 50, 10**6)}") for i in range(6)] + [(10, " ".join(t))]
    assert s.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_passage_repeated_inside_a_text(spark):
    rng = random.Random(8)
    p = sentence(rng, 70, 10**6)
    text = f"{sentence(rng, 30, 10**6)} {p} {sentence(rng, 40, 10**6)} {p} {sentence(rng, 10, 10**6)} {p}"
    df = spark.createDataFrame([(1, text), (2, sentence(rng, 300, 10**6))], "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word, r.source_id, r.is_first) for r in s.repeated_passages(df).collect()}
    assert got == {(1, 30, 100, 1, True), (1, 140, 210, 1, False), (1, 220, 290, 1, False)}
    assert s.without_passages(df).where("doc_id = 1").first().text.count(p) == 1


def test_hot_seeds_dealt_to_several_tasks(spark):
    """Dealing seeds out loses no document, whichever source each names."""
    rng = random.Random(9)
    p, q = sentence(rng, 60, 10**6), sentence(rng, 50, 10**6)
    rows = [(i, f"{sentence(rng, 20, 10**6)} {p if i % 3 else q} {sentence(rng, 20, 10**6)}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [{(r.doc_id, r.start_word, r.end_word, r.is_first) for r in s.repeated_passages(df, hot=h).collect()} for h in (5, s.HOT)]
    assert spans[0] == spans[1] and len(spans[0]) == 90


def test_long_texts_and_ties(spark):
    """Two long equal texts are one passage of their whole length; of equal sources the least is named."""
    rng = random.Random(10)
    t = sentence(rng, 30_000, 10**6)
    df = spark.createDataFrame([(5, t), (6, t), (7, t), (8, "a b " * 5000)], "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in s.repeated_passages(df, first=False).where("doc_id < 8").collect()}
    assert got == {(6, 0, 30_000, 5), (7, 0, 30_000, 5)}


def quoted(rng, i, windows, before=True, edits=0):
    """Texts (id, text): windows of a passage of 120 words in texts of their own, before (or around) two texts that have it whole."""
    around = lambda n: sentence(rng, n, 10**6)
    passage = around(120).split()
    small = [f"{around(20)} {' '.join(passage[a : a + n])} {around(20)}" for a, n in windows]
    later = list(passage)
    for k in rng.sample(range(120), edits):
        later[k] = f"new{rng.randrange(10**9)}"
    whole = [f"{around(30)} {' '.join(passage)} {around(30)}", f"{around(40)} {' '.join(later)} {around(20)}"]
    ids = [*range(len(small)), *(len(small) + 900, len(small) + 901)] if before else [2 * k for k in range(len(small))] + [1, 2 * len(small) + 1]
    return [(i * 10_000 + n, t) for n, t in zip(ids, small + whole)]


def test_quotations_hide_no_passage(spark):
    """Earlier texts with windows of 20, 30, 40 and 44 words, five or 300 of them, also between the two and with edits."""
    rng = random.Random(11)
    cases = [[(a, n) for a in range(0, 120 - n + 1, 20)] for n in (20, 30, 40) for _ in range(8)]
    cases += [[(a, 44) for a in [*range(0, 76, 19), 76] for _ in range(60)]] + [[(a, 40) for a in range(0, 81, 20)]] * 6
    rows = [r for i, w in enumerate(cases) for r in quoted(rng, i, w, i < 25 or i % 2 == 0, 6 if i >= 27 else 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in s.repeated_passages(df, first=False).collect():
        assert 40 <= r.start_word + 8 and r.end_word <= 160 + 8, r
        got[r.doc_id // 10_000] = max(got.get(r.doc_id // 10_000, 0), r.n_words)
    found = [got.get(i, 0) >= 100 for i in range(len(cases))]
    assert sum(found) >= 0.95 * len(cases), [(i, len(w), got.get(i)) for i, w in enumerate(cases) if not found[i]]


def brute_passages(texts, n=45):
    """Ids of texts with a run of n words that an earlier text has."""
    seen, out = set(), set()
    for i in sorted(texts):
        w = texts[i].split()
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if grams & seen:
            out.add(i)
        seen |= grams
    return out


def test_recall_on_a_corpus_of_quotations(spark):
    """Texts made of quotations of 10 to 44 words from a few sources, which some later texts hold in full."""
    rng = random.Random(12)
    sources = [sentence(rng, 300, 10**6).split() for _ in range(12)]
    texts = {}
    for i in range(400):
        words = sentence(rng, 30, 10**6).split()
        for _ in range(3):
            src, n = rng.choice(sources), rng.randint(10, 44)
            a = rng.randrange(300 - n)
            words += src[a : a + n] + sentence(rng, 15, 10**6).split()
        if i > 100 and i % 3 == 0:
            src, n = rng.choice(sources), rng.randint(60, 140)
            a = rng.randrange(300 - n)
            words += src[a : a + n]
        texts[i] = " ".join(words)
    want = brute_passages(texts)
    got = {r.doc_id for r in s.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), first=False).collect()}
    assert len(want) > 30 and len(want & got) >= 0.95 * len(want), (len(want), len(want & got))
    assert len(got - want) <= 0.1 * len(want)


def test_first_least_equals_plain_windows():
    """Against each window's own argmin, with many ties, for spans that are powers of two or not."""
    rng = np.random.default_rng(3)
    for n, span in ((1, 1), (14, 14), (15, 14), (500, 14), (500, 8), (500, 5), (500, 1)):
        g = rng.integers(0, 6, n).astype(np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(g, span)
        assert s.first_least(g, span).tolist() == (view.argmin(axis=1) + np.arange(len(view))).tolist()
