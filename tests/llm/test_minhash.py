import random

from pyspark.sql import functions as F

from helpers import sentence, shingle_set, union_find
from lamina.llm import minhash
from lamina.llm.shared import components


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = sentence(rng, rng.randint(30, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):  # near copies, in chains
            if rng.random() < 0.5:
                base = list(base)
            base[rng.randrange(len(base))] = f"edit{rng.random()}"
            texts.append(" ".join(base))
    return texts + [texts[0]] * 5 + [texts[0].upper()] + [None, "", " \n ", "one two", "one two", "ONE  TWO", "one two three four five", "x " * 40]


def brute(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(i, len(sets[i]), c, c == i) for i, c in enumerate(union_find(len(sets), pairs))]


def test_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"rep": F.lit(1), "key": F.lit("clash")})
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert got == brute(texts)


def test_many_alike_texts(spark, monkeypatch):
    """A large group of texts around the limit: blocks of a few rows, nothing lost."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = sentence(rng, 120, 10_000).split()
    texts = []
    for i in range(60):
        t = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 6])):
            t[k] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute(texts)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (7, 0, 7, True)], key=str)
    assert sorted(r.doc_id or 0 for r in minhash.one_of_each(df).collect()) == [0, 1, 1, 7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0


def test_components_of_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(e).collect()} == {0}
