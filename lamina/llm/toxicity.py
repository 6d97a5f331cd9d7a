"""Toxic passages: maximal scoring segments over token log-odds, with extreme-value calibration.

1. Tokens are words and their 6- and 8-byte beginnings, without outer ASCII punctuation. Each has a
   log-odds of occurring in toxic against other training texts, under a Dirichlet prior informed by
   its rate in all documents. Documents are counted, not occurrences, as a word that one text
   repeats is no evidence. A token scores the lower confidence limit of its log-odds.
2. A word scores its best token, or -DRIFT. A linear-time scan finds every maximal scoring segment.
3. A segment of score s among n words has the expected count K n exp(-lambda s) by chance; lambda
   solves the moment equation of the scores of other text and K matches the segments seen there.
   Evidence -log(expected count) of the best segment and summed over the significant ones go
   through a logistic fit to a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bloom, forget, in_arrow, in_bloom, small, written
from .words import hash_spans, mix, slices

FOLDS = 5
PRIOR_DOCS = 50.0
PRIOR_BASE = 0.5
CONFIDENCE = 2.5
MIN_COUNT = 4
BEGINNINGS = (6, 8)
DRIFT = 0.1
MAX_TERMS = 4_000_000  # 48 MB; more terms raise an error

_OUTER = np.zeros(256, dtype=bool)
_OUTER[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0


def _trimmed(s) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without outer punctuation, of any length; a word of nothing else keeps its first byte."""
    start, end = s.start.copy(), s.end.copy()
    for edge, step, back in ((end, -1, 1), (start, 1, 0)):
        at = np.arange(len(start))
        while len(at):  # only words that lost a byte are looked at again
            at = at[(end[at] - start[at] > 1) & _OUTER[s.buf[edge[at] - back]]]
            edge[at] += step
    return start, end


def tokens(s) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of token: the words that have one, and its hash."""
    start, end = _trimmed(s)
    every = np.arange(len(start))
    out = [(every, hash_spans(s.buf, start, end))]
    for k, size in enumerate(BEGINNINGS):
        has = np.flatnonzero(end - start > size)
        out.append((has, hash_spans(s.buf, start[has], start[has] + size) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))))
    return out


def train_labels(labels: DataFrame) -> DataFrame:
    """One (id, toxic) for each rated id outside the held-out fold."""
    return (
        labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_lid")).agg(F.max("toxic").alias("_toxic")).where(~held_out(F.col("_lid")))
    )


WORDS_OF_OTHER = -1  # the row of word totals in a count table


def _counts(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(token, y_all, y_tox, y_other), in texts, of rows (text, class); token null has the numbers of texts, WORDS_OF_OTHER the words of class 2."""

    def run(batches):
        import pyarrow as pa

        total, length = np.zeros(3, np.int64), 0
        for batch in batches:
            cls_all = batch.column(1).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(0)):
                cls = cls_all[s.lo : s.hi]
                total += [len(cls), (cls == 1).sum(), (cls == 2).sum()]
                length += int(s.counts()[cls == 2].sum())
                row = np.repeat(np.arange(s.hi - s.lo, dtype=np.uint64), s.counts())
                h, r = [], []
                for words, hashes in tokens(s):
                    if wanted is not None:
                        hit = in_bloom(wanted, hashes.view(np.int64))
                        words, hashes = words[hit], hashes[hit]
                    h.append(hashes)
                    r.append(row[words])
                h, r = np.concatenate(h), np.concatenate(r)
                once = np.unique(mix(h) + mix(r), return_index=True)[1]  # each token once a text
                h, c = h[once], cls[r[once].astype(np.int64)]
                u, inv = np.unique(h, return_inverse=True)
                n = [np.bincount(inv, minlength=len(u)), np.bincount(inv[c == 1], minlength=len(u)), np.bincount(inv[c == 2], minlength=len(u))]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, n)], ["token", "y_all", "y_tox", "y_other"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([int(x)]) for x in total)], ["token", "y_all", "y_tox", "y_other"])
        yield pa.RecordBatch.from_arrays([pa.array([WORDS_OF_OTHER], pa.int64()), *(pa.array([length]) for _ in total)], ["token", "y_all", "y_tox", "y_other"])

    return (
        rows.transform(in_arrow, run, "token long, y_all long, y_tox long, y_other long")
        .groupBy("token").agg(*(F.sum(c).alias(c) for c in ("y_all", "y_tox", "y_other")))
    )


@dataclass
class Model:
    token: np.ndarray  # sorted
    score: np.ndarray
    lam: float
    k: float
    weights: tuple[float, float, float] = (-3.0, 0.5, 0.0)


def learn_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model:
    """The scored terms and the rate of chance segments; statistics cover all documents."""
    train = small(train_labels(labels))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(train, F.col("_id") == F.col("_lid"), "left")
    rows = rows.select("text", F.when(F.col("_toxic") == 1, 1).when(F.col("_toxic") == 0, 2).otherwise(0).cast("int").alias("class"))
    seen = written(_counts(rows.where("class = 1"), None).where(f"token is not null and y_tox >= {MIN_COUNT}").select("token"), "seen")
    counts = written(_counts(rows, bloom(seen, "token")), "tokens")
    totals = counts.where("token is null").agg(*(F.sum(c).alias(c) for c in ("y_all", "y_tox", "y_other"))).first()
    n_all, n_t, n_o = (float(totals[c] or 0) for c in ("y_all", "y_tox", "y_other"))
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0)
    if not n_t or not n_o:
        return empty
    a = F.col("y_all") * F.lit(PRIOR_DOCS / n_all) + F.lit(PRIOR_BASE)
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(n + PRIOR_DOCS) - F.col(y)))
    sd = F.sqrt(1 / (F.col("y_tox") + a) + 1 / (F.col("y_other") + a))
    low = odds("y_tox", n_t) - odds("y_other", n_o) - F.lit(CONFIDENCE) * sd
    terms = counts.join(seen, "token").withColumn("score", low).where("score > 0").select("token", "score", F.col("y_other").alias("other"))
    terms = written(terms, "terms")
    if terms.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} toxic terms")
    t = terms.toArrow()
    words = max(float(counts.where(F.col("token") == WORDS_OF_OTHER).agg(F.coalesce(F.sum("y_all"), F.lit(0)).alias("n")).first()["n"]), 1.0)
    for x in (seen, counts, terms):
        forget(x)
    if not len(t):
        return empty
    token, score, rate = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy(), t.column(2).to_numpy() / words
    order = np.argsort(token)
    token, score, rate = token[order], score[order], rate[order] + 1e-9
    lo, hi = 0.0, 50.0 / score.max()
    f = lambda x: (rate * np.exp(np.minimum(x * score, 600))).sum() + max(0.0, 1 - rate.sum()) * math.exp(-x * DRIFT) - 1
    for _ in range(80):  # the positive root
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return Model(token, score, max(lo, 1e-3), 1.0)


def maximal_segments(position: np.ndarray, value: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) where ``position`` has the scoring words and others cost ``drift``.

    The list-based linear scan: each candidate remembers the totals before and after it.
    """
    segs: list[list[float]] = []  # first, last, total before, total after
    total, last = 0.0, -1
    for p, v in zip(position.tolist(), value.tolist(), strict=True):
        total -= drift * (p - last - 1)
        cand = [p, p, total, total + v]
        total += v
        last = p
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][2] >= cand[2]:
                j -= 1
            if j < 0 or segs[j][3] >= cand[3]:
                segs.append(cand)
                break
            cand = [segs[j][0], cand[1], segs[j][2], cand[3]]
            del segs[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in segs]


def word_scores(s, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The words of a slice that score, and their scores."""
    best = np.zeros(len(s.start))
    if len(model.token):
        for words, hashes in tokens(s):
            at = np.minimum(np.searchsorted(model.token, hashes), len(model.token) - 1)
            hit = np.flatnonzero(model.token[at] == hashes)
            np.maximum.at(best, words[hit], model.score[at[hit]])
    hits = np.flatnonzero(best)
    return hits, best[hits]


SEGMENTS = "array<struct<first:int,last:int,start_byte:int,end_byte:int,score:double,evidence:double>>"


def passages(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, segments of each text: word and byte range, score, and evidence -ln(expected count)."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]))
        for batch in batches:
            for s in slices(batch.column(1)):
                hits, value = word_scores(s, model)
                at = np.searchsorted(hits, s.row)
                out = []
                n = s.counts()
                for i in range(s.hi - s.lo):
                    a, b = at[i], at[i + 1]
                    if a == b:
                        out.append([])
                        continue
                    first = int(s.row[i])
                    got = []
                    for x, y, v in maximal_segments(hits[a:b] - first, value[a:b], DRIFT):
                        e = model.lam * v - math.log(max(model.k * float(n[i]), 1e-12))
                        got.append({"first": x, "last": y, "start_byte": int(s.start[first + x] - s.bytes_at[i]), "end_byte": int(s.end[first + y] - s.bytes_at[i]), "score": v, "evidence": e})
                    out.append(got)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(n.astype(np.int64)), pa.array(out, kind)], ["id", "n_words", "segments"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, f"id long, n_words long, segments {SEGMENTS}")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_words, segments, score, predicted: one row for each row of docs.

    Null or wordless texts have no segment and get the score of no evidence. Rows with a null id are
    scored and never learnt from. Without toxic or other training rows every score is below 0.5.
    Repeated ids and rows are scored by their texts. Other columns are ignored.
    """
    model = learn_terms(docs, labels, id_col, text_col)
    found = written(passages(docs, model, id_col, text_col), "passages")
    train = small(train_labels(labels))
    rated = found.join(train, F.col("id") == F.col("_lid"))
    # K: chance segments of at least the typical score per word of other training text.
    other = rated.where("_toxic = 0")
    n_other = other.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    if n_other and len(model.score):
        s0 = float(np.median(model.score))
        many = other.select(F.explode("segments").alias("s")).where(F.col("s.score") >= s0).count()
        model.k = max((many + 0.5) / (n_other * math.exp(-min(model.lam * s0, 600.0))), 1e-12)
    shift = F.log(F.greatest(F.lit(model.k) * F.col("n_words"), F.lit(1e-12)))
    evidence = F.transform("segments", lambda s: s.withField("evidence", F.lit(model.lam) * s["score"] - shift))
    with_e = lambda df: (
        df.withColumn("segments", evidence)
        .withColumn("best", F.least(F.greatest(F.coalesce(F.array_max(F.transform("segments", lambda s: s["evidence"])), F.lit(0.0)), F.lit(0.0)), F.lit(40.0)))
        .withColumn("all", F.least(F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + F.greatest(s["evidence"], F.lit(0.0))), F.lit(80.0)))
    )
    cells = (  # at most 81 * 81 cells and 2 labels
        with_e(rated).groupBy(F.round(2 * F.col("best")).alias("best"), F.round("all").alias("all"), F.col("_toxic").alias("y")).count().collect()
    )
    if len({c["y"] for c in cells}) == 2:
        x = np.array([[c["best"] / 2, c["all"]] for c in cells])
        b = _logistic(x, np.array([float(c["y"]) for c in cells]), np.array([float(c["count"]) for c in cells]))
        model.weights = tuple(float(v) for v in b)
    w0, w1, w2 = model.weights
    score = 1 / (1 + F.exp(-(F.lit(w0) + F.lit(w1) * F.col("best") + F.lit(w2) * F.col("all"))))
    return with_e(found).select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "n_words", "segments", score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )
