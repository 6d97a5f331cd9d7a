"""Quality rules: text statistics and a hashed n-gram likelihood ratio, in DataFrame functions only.

A document's score is the mean, over its hashed word unigrams and bigrams, of
log p_target(bucket) - log p_raw(bucket). The raw multinomial counts every document, the target one
the trusted documents but for one fold in CALIBRATION_FOLDS (by a hash of the id), which sets the
threshold: its scores are distributed like those of unrated documents, as its words were not learnt.
PRIOR pseudo-counts per bucket, at the scale of the target, pull rare buckets to a ratio of zero.
Every document is thresholded the same way, without sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import empty_text, written

SEPARATORS = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
BUCKETS = 1 << 16
PRIOR = 5.0
CALIBRATION_FOLDS = 5
BROADCAST_IDS = 2_000_000  # trusted ids up to this many (32 MB) are broadcast; more are joined by shuffle
CELLS = 1000  # a ratio is between -20 and 20, so a histogram has at most 40,000 cells for each rating
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def with_word_hashes(df: DataFrame, text_col: str) -> DataFrame:
    """Adds _words and _wh (a hash per word)."""
    return df.withColumn("_words", words_of(empty_text(F.col(text_col)))).withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w)))


def feature_buckets(wh: str = "_wh", buckets: int = BUCKETS) -> Column:
    """The buckets of all unigrams, then of all bigrams."""
    mask = F.lit(buckets - 1).cast("long")
    after = F.slice(wh, 2, F.greatest(F.size(wh) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(wh, 1, F.greatest(F.size(wh) - 1, F.lit(0))), after, lambda a, b: F.xxhash64(a, b).bitwiseAND(mask))
    return F.concat(F.transform(wh, lambda h: h.bitwiseAND(mask)), pairs)


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside windows of WINDOW words that the text has twice or more.

    Windows are compared by 64-bit hashes. The sort runs only for texts that repeat a window.
    """
    n = F.size("_wh")
    hs = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_wh", i, WINDOW)))).otherwise(
        F.array().cast("array<long>")
    )
    df = df.withColumn("_hs", hs)
    df = df.withColumn("_again", F.size(F.array_distinct("_hs")) < F.size("_hs"))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, h: F.coalesce(F.get("_sorted", k)["h"] == h, F.lit(False))
    df = df.withColumn(
        "_starts",
        F.sort_array(F.transform(F.filter("_sorted", lambda x, k: same(k - 1, x["h"]) | same(k + 1, x["h"])), lambda x: x["i"])),
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(0).cast("long")).drop("_hs", "_again", "_sorted", "_starts")


def calibrates(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % CALIBRATION_FOLDS == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids of rows rated quality 1 that the target counts; broadcast only behind a count."""
    ids = labels.where("quality = 1 and doc_id is not null").where(~calibrates(F.col("doc_id"))).select(F.col("doc_id").alias("_trusted")).distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def ratio_table(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio) for each of the ``buckets`` buckets. Empty if nothing is trusted."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(trusted_ids(labels), F.col("_id") == F.col("_trusted"), "left")
    counts = (
        with_word_hashes(rows.withColumn("_good", F.col("_trusted").isNotNull().cast("long")), "_text")
        .select("_good", F.explode(feature_buckets(buckets=buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("_good").alias("target"))
    )
    counts = written(counts, "ngrams")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    if not total["target"]:
        return counts.where("false").select("bucket", F.lit(0.0).alias("ratio"))
    aligned = F.coalesce("raw", F.lit(0)) * F.lit(total["target"] / total["raw"])
    return (
        docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
        .select("bucket", F.log((F.coalesce("target", F.lit(0)) + F.lit(PRIOR)) / (aligned + F.lit(PRIOR))).alias("ratio"))
    )


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ratio (null without trusted text or words)."""
    table = ratio_table(docs, labels, id_col, text_col, buckets)
    # At most `buckets` doubles, whatever the input.
    dense = table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("t")).scalar()
    text = empty_text(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD))
    df = with_word_hashes(docs, text_col).withColumn("_lines", lines).withColumn("_features", feature_buckets(buckets=buckets)).withColumn("_t", dense)
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("ratio", F.aggregate("_features", F.lit(0.0), lambda acc, b: acc + F.get("_t", b.cast("int"))) / F.nullif(F.size("_features"), F.lit(0)))
    )
    return repeated_words(df).drop("_words", "_wh", "_lines", "_features", "_t")


def quantile(cells: list[tuple[int, int]], share: float) -> float | None:
    """The least ratio that ``share`` of the counted rows do not exceed, from (cell, rows) in order."""
    rank, seen = math.ceil(share * sum(n for _, n in cells)), 0
    for cell, n in cells:
        seen += n
        if seen >= max(rank, 1):
            return cell / CELLS
    return None


def threshold(scores: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> float | None:
    """Midway between the 0.1 % quantile of held-out trusted and the 99.9 % quantile of rejected documents that pass the base rules.

    Where the two overlap or no rejected document is known, the limit lies below the trusted quantile
    by half its distance from the trusted median, so that clean text stays. Ratios are counted in cells
    of 1 / CELLS, so the quantiles are exact to a cell and do not depend on the order of merging.
    """
    rated = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_rated")).agg(F.max("quality").alias("_q"))
    cells = (
        scores.where("not base_failed and ratio is not null").join(rated, F.col(id_col) == F.col("_rated")).withColumn("_held", calibrates(F.col(id_col)))
        .where("_q = 0 or _held").groupBy("_q", F.round(F.col("ratio") * CELLS).cast("long").alias("cell")).agg(F.count("*").alias("n")).collect()
    )  # at most 2 * 2 * CELLS * the greatest ratio, whatever the input
    good, bad = (sorted((c["cell"], c["n"]) for c in cells if c["_q"] == q) for q in (1, 0))
    q = {"good": quantile(good, 0.001), "bad": quantile(bad, 0.999), "mid": quantile(good, 0.5)}
    if q["good"] is None:
        return None
    if q["bad"] is None or q["bad"] > q["good"]:
        return q["good"] - (q["mid"] - q["good"]) / 2
    return (q["good"] + q["bad"]) / 2


def rejected_rows(rated: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Distinct (id, text_hash) of the rows that quality_rules does not keep; broadcast only behind a count."""
    gone = rated.where("not kept").select(F.col(rated.columns[0]).alias("_rid"), F.col("text_hash").alias("_rhash")).distinct()
    return F.broadcast(gone) if gone.limit(limit + 1).count() <= limit else gone


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, unchanged. A row is told by its id and a hash of its text, so null and repeated ids are safe."""
    gone = rejected_rows(quality_rules(docs, labels, id_col, text_col))
    own = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_rid"]) & (own == gone["_rhash"]), "left_anti")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, text_hash, ratio, n_repeat_words, base_failed, kept: one row for each row of docs.

    A null or wordless text has zero counts and fails the base rules. Without trusted labels only the
    base rules count. Null ids are rated like others; repeated rows get equal results. Other columns
    of docs are left aside, so clashing names do no harm.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_body"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scores = scored(rows.withColumn("text_hash", F.xxhash64("_body")), labels, id_col, "_body", buckets).drop("_body").withColumn("base_failed", base)
    scores = written(scores, "scores")
    limit = threshold(scores, labels, id_col)
    verdict = F.lit(True) if limit is None else F.coalesce(F.col("ratio") >= limit, F.lit(True))
    return scores.withColumn("kept", ~F.col("base_failed") & verdict)
