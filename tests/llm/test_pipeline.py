"""The stages together against plain Python, on a small folder."""

import random

from helpers import sentence, words


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    passage = sentence(rng, 60, 10**6)
    item = sentence(rng, 25, 10**6)
    docs = {i: sentence(rng, 80, 10**6) for i in range(40)}
    docs[5] = docs[4].replace(docs[4].split()[40], "edit")  # near copy
    docs[6] = docs[4]
    docs[10] += " " + passage
    docs[11] = passage + " " + docs[11]
    docs[20] = docs[20] + " " + item + " " + sentence(rng, 20, 10**6)
    docs[30] = "too short"
    docs[31] = ("again and again it says the very same thing " * 20).strip()
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = frame.columns
    for name, stage in cp.STAGES:
        frame = cp.written(stage(spark, frame, str(tmp_path)), "stage")
        seen[name] = {r.doc_id: r for r in frame.collect()}
        assert name == cp.STAGES[-1][0] or frame.columns == names
    assert set(docs) - set(seen["quality rules"]) == {30, 31}
    assert set(seen["quality rules"]) - set(seen["near duplicates"]) == {5, 6}
    cut = seen["substring dedup"]
    assert set(cut) == set(seen["near duplicates"]) and words(cut[11].text) == words(docs[11])[60:] and cut[11].n_chars == len(cut[11].text)
    assert all(cut[i].text == docs[i] for i in cut if i != 11)
    assert set(cut) - set(seen["benchmark decontamination"]) == {20}
    last = seen["sentencepiece"]
    assert set(last) == set(seen["benchmark decontamination"]) and all(last[i].n_chars == len(cut[i].text) and last[i].n_tokens == len(last[i].ids) for i in last)


def _folder(spark, path, rows, extra):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(7) for c in extra}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, ""), (None, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null and wordless texts fail the base rules; of repeated rows one stays; other columns pass through all stages but the last."""
    import corpus_pipeline as cp

    rng = random.Random(3)
    a, b, c = (sentence(rng, 60, 10**6) for _ in range(3))
    rows = [(1, a), (1, a), (2, None), (3, ""), (4, " \n\t "), (None, b), (5, c), (6, "é漢 " * 5)]
    extra = ["ratio", "kept", "component_id", "_gone", "_sid", "_spans", "_rid", "hash"]
    _folder(spark, tmp_path, [(i, t, "en", None, len(t or "")) for i, t in rows], extra)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = frame.columns
    for name, stage in cp.STAGES[:-1]:
        frame = cp.written(stage(spark, frame, str(tmp_path)), "stage")
        assert frame.columns == names, name
    kept = frame.collect()
    assert {r.text for r in kept} == {a, b, c} and sum(r.text == b for r in kept) == 1
    assert all(r[n] == 7 for r in kept for n in extra)
    assert cp.STAGES[-1][1](spark, frame, str(tmp_path)).count() == len(kept)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    _folder(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0
