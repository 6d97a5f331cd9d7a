import numpy as np
import pytest

from lamina.llm import divergence as D
from lamina.llm.queries import QUERIES, SQL

from oracle import compare


def exact(rows, term_docs=3):
    """The contract, group by group, in plain integers."""
    import re
    from collections import Counter, defaultdict

    docs = defaultdict(set)
    counts = defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        for t in terms:
            docs[lang, t].add(i)
    out = {}
    for lang, source in counts:
        kept = [t for (l, t), d in docs.items() if l == lang and len(d) >= term_docs]
        of = {s: c for (l, s), c in counts.items() if l == lang}
        share = lambda c, t, k=kept: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in k) + len(k))
        whole = sum(of.values(), Counter())
        pairs = [(s, sum((share(of[source], t) - share(c, t)) ** 2 // share(c, t) for t in kept)) for s, c in of.items() if s != source]
        terms = [(t, (share(of[source], t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if of[source][t] and share(of[source], t) > share(whole, t)]
        for part, found, most in (("pair", pairs, None), ("term", terms, D.TOP_TERMS)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            for rank, (item, value) in enumerate(found[:most], 1):
                out[lang, source, part, item] = value, rank
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, source string, term long, rank string")
    return {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in D.source_divergence(df).collect()}


def test_equals_plain_arithmetic_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CELLS", 40)
    monkeypatch.setattr(D, "FRONTIER", 64)
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)] + ["ÄÖ", "éa", "ZZ"]
    rows = [(" ".join(rng.choice(words, 12)) + "; x-1y", "en" if i % 3 else "de", f"s{rng.integers(0, 9) if i % 2 else 0}") for i in range(120)]
    assert found(spark, rows) == exact(rows)


def test_edges(spark):
    rows = [(None, None, None), ("", "en", "a"), ("one", "en", "b"), ("a b", "fr", "a"), ("a b", "fr", "a"), ("A-b", "fr", None), ("a " * 50_000, "fr", "z" * 300), ("é" * 200_000, "fr", "c")]
    assert found(spark, rows) == exact(rows)
    assert found(spark, []) == {}


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 10)
    raw = b"abc def   ghijklmnopqrstuvw x yz"
    assert [w for p in D._pieces(raw) for w in p.split()] == raw.split()


@pytest.mark.parametrize("rows,cols,limit", [(1, 7, 4), (2, 1, 4), (5, 40, 16), (17, 100, 1 << 19)])
def test_joint_walk_counts_every_column_once(rows, cols, limit):
    rng = np.random.default_rng(rows)
    m = rng.integers(0, 6, (rows, cols))
    m[m < 4] = 0
    m[0, m.sum(0) == 0] = 1
    r, c = np.nonzero(m)
    shuffled = rng.permutation(len(r))
    r, c = r[shuffled], c[shuffled]
    forest = D.Forest(r, c, rows, cols)
    value = m[r, c][forest.order]
    seen = np.zeros((rows, rows), dtype=np.int64)

    def leaf(a, b, ia, ib):
        np.add.at(seen, (a, b), np.where(ia >= 0, value[ia], 0) * 7 + np.where(ib >= 0, value[ib], 0))

    empty = forest.pairs(leaf, limit)
    for a in range(rows):
        for b in range(a + 1, rows):
            assert empty[a, b] == np.sum((m[a] == 0) & (m[b] == 0)) and seen[a, b] == (7 * m[a] + m[b]).sum()


def test_query_equals_sql(spark):
    assert compare(spark, QUERIES["op12_divergence"], SQL["op12_divergence"], "/root/testdata/sf0.001") > 0
