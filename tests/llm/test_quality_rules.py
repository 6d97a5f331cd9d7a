import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from helpers import sentence
from lamina.llm import quality_rules as q


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    marked = {i for v in at.values() if len(v) > 1 for s in v for i in range(s, s + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n\t ", "é ß x 漢", "a\nb\na\n \na", "a " * 50, "x | y # $$ <b>", sentence(rng, 300), sentence(rng, 40) + "\n" + sentence(rng, 9, 3) * 6, "word " * 5000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(8, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ratio": F.lit("clash"), "n_words": F.lit(-1)})
    labels = spark.createDataFrame([(7, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality_rules(df, labels).collect()}
    assert got == {i: stats(t) for i, t in enumerate(texts)}


def test_ratio_equals_brute_force_and_separates(spark):
    rng = random.Random(2)
    good = [sentence(rng, 60, 300) for _ in range(60)]
    bad = [" ".join(f"j{rng.randrange(300)}!!" for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(i, 0, 0) for i in range(60, 70)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.quality_rules(df, labels).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))
    rows = q.with_word_hashes(df, "text").withColumn("f", q.feature_buckets()).select("doc_id", "f", q.calibrates(F.col("doc_id")).alias("c")).collect()
    raw, target = defaultdict(int), defaultdict(int)
    for r in rows:
        for b in r.f:
            raw[b] += 1
            target[b] += r.doc_id < 40 and not r.c
    import math

    share = sum(target.values()) / sum(raw.values())
    for r in rows:
        want = sum(math.log((target[b] + q.PRIOR) / (raw[b] * share + q.PRIOR)) for b in r.f) / len(r.f)
        assert abs(got[r.doc_id].ratio - want) < 1e-9


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 5), (None, " ".join(f"a{i}" for i in range(30)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.kept) for r in q.quality_rules(df, none).collect()} == {(1, False), (None, True)}
    assert q.quality_rules(df.where("false"), none).count() == 0
    assert [r.doc_id for r in q.kept_documents(df, none).collect()] == [None]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = q.scored(df, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_threshold_is_exact_to_a_cell(spark):
    """Quantiles by counted cells equal those of the sorted rows, whatever the partitions."""
    rng = random.Random(5)
    rows = [(i, rng.gauss(1 if i % 2 else -1, 0.3), i % 2) for i in range(4000)]
    df = spark.createDataFrame([(i, x, False) for i, x, _ in rows], "doc_id long, ratio double, base_failed boolean")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    import math
    import zlib

    good = sorted(x for i, x, y in rows if y and zlib.crc32(str(i).encode()) % q.CALIBRATION_FOLDS == 0)
    bad = sorted(x for _, x, y in rows if not y)
    g, b, m = good[max(math.ceil(0.001 * len(good)), 1) - 1], bad[math.ceil(0.999 * len(bad)) - 1], good[math.ceil(0.5 * len(good)) - 1]
    want = g - (m - g) / 2 if b > g else (g + b) / 2
    got = {q.threshold(df.repartition(n), labels) for n in (1, 7)}
    assert len(got) == 1 and abs(got.pop() - want) <= 2 / q.CELLS
