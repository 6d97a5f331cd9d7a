"""Ordinal quality classifier: a cumulative-link (proportional odds) model on hashed text.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all grades and ordered thresholds
t_0 < t_1 < ...; x is the mean over a text's words of hashed unigrams,
bigrams and word shapes (letter case and outer punctuation). Buckets in fewer than MIN_TEXTS texts of
the sample keep a zero weight, since they would only memorise it. It gives the
expected grade and the tail probability P(grade >= cut) for selection.

The fit uses the SAMPLE rated texts of smallest id hash, the one bounded part; every text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow
from .words import mix, slices

BITS = 18
SAMPLE = 10_000
EPOCHS = 150
MIN_TEXTS = 5
RIDGE = 1e-9

_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(10)  # punctuation stands for itself
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray


def shapes(s) -> np.ndarray:
    """A hash of the classes of each word's first two and last three bytes."""
    h = np.zeros(len(s.start), np.uint64)
    last = s.end - 1
    with np.errstate(over="ignore"):
        for at in (s.start, np.minimum(s.start + 1, last), last, np.maximum(last - 1, s.start), np.maximum(last - 2, s.start)):
            h = h * np.uint64(0x100000001B3) + _CLASS[s.buf[at]]
    return mix(h ^ np.uint64(0x5BD1E9955BD1E995))


def _features(s, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all unigrams, shapes and bigrams of a slice."""
    mask = np.uint64((1 << bits) - 1)
    row = np.repeat(np.arange(s.hi - s.lo), s.counts())
    uni = (s.hash & mask).astype(np.int64)
    shape = shapes(s)
    form = (shape & mask).astype(np.int64)
    if len(row) < 2:
        return np.concatenate([row, row]), np.concatenate([uni, form])
    with np.errstate(over="ignore"):
        bi = (mix(s.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + s.hash[1:]) & mask).astype(np.int64)
        forms = (mix(shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]) & mask).astype(np.int64)
    inside = row[1:] == row[:-1]
    return np.concatenate([row, row, row[1:][inside], row[1:][inside]]), np.concatenate([uni, form, bi[inside], forms[inside]])


def rated_features(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str, sample: int, bits: int) -> DataFrame:
    """(grade, bucket, value) lists of the ``sample`` rated texts of smallest id hash."""
    chosen = grades.orderBy(F.xxhash64("_gid"), "_gid").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_gid"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch.column(1)):
                row, bucket = _features(s, bits)
                key, n = np.unique(row * (1 << bits) + bucket, return_counts=True)
                total = np.maximum(np.bincount(row, minlength=s.hi - s.lo), 1)
                r = key >> bits
                at = np.searchsorted(r, np.arange(s.hi - s.lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.lo, s.hi - s.lo),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((n / total[r]).astype(np.float32))),
                    ],
                    ["grade", "bucket", "value"],
                )

    return rows.select(F.col("_grade").cast("int").alias("grade"), "text").transform(in_arrow, run, "grade int, bucket array<int>, value array<float>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def ordered_cuts(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the gaps."""
    return np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def loss_and_gradient(w: np.ndarray, free: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood (rows weighted by ``balance``, weights with a small ridge) and its gradients."""
    k = len(free)
    bound = np.concatenate([[-np.inf], ordered_cuts(free), [np.inf]])
    f = np.bincount(row, weights=w[idx] * val, minlength=len(y))
    up, lo = _sigmoid(bound[y + 1] - f), _sigmoid(bound[y] - f)
    up[y == k], lo[y == 0] = 1.0, 0.0
    p = np.maximum(up - lo, 1e-12)
    du, dl = up * (1 - up) / p * balance, lo * (1 - lo) / p * balance
    gf = (du - dl) / len(y)
    gt = np.array([-(du[y == j].sum() - dl[y == j + 1].sum()) for j in range(k)]) / len(y)
    g_free = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(free[j]) for j in range(1, k)]])
    gw = np.bincount(idx, weights=val * gf[row], minlength=len(w)) + RIDGE * w
    return float(-(balance * np.log(p)).mean() + RIDGE / 2 * (w @ w)), gw, g_free


def fit(features: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> Ordinal | None:
    """Maximum penalised likelihood by Adam on the bounded sample; None without two grades."""
    t = features.toArrow()
    grade = t.column("grade").to_numpy()
    present = np.unique(grade)
    if len(present) < 2:
        return None
    y = np.searchsorted(present, grade)
    lists = t.column("bucket").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    idx, val = lists.flatten().to_numpy(), t.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(y)), size)
    common = np.bincount(idx, minlength=1 << bits)[idx] >= MIN_TEXTS
    idx, val, row = idx[common], val[common], row[common]
    k = len(present) - 1
    balance = len(y) / (len(present) * np.bincount(y, minlength=len(present)))[y]
    balance = np.sqrt(balance / balance.mean())  # halfway between the grades' shares and equal weight
    w = np.zeros(1 << bits)
    free = np.concatenate([[-1.0], np.zeros(k - 1)])  # t_0, then logs of the gaps
    m = [np.zeros_like(w), np.zeros_like(free)]
    v = [np.zeros_like(w), np.zeros_like(free)]
    for step in range(1, epochs + 1):
        _, gw, g_free = loss_and_gradient(w, free, idx, val, row, y, balance)
        for i, (x, g, rate) in enumerate(((w, gw, 0.5), (free, g_free, 0.05))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)
    return Ordinal(w.astype(np.float32), ordered_cuts(free))


def linear_scores(docs: DataFrame, model: Ordinal, id_col: str, text_col: str, bits: int) -> DataFrame:
    weights = model.weights

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch.column(1)):
                row, bucket = _features(s, bits)
                n = np.maximum(np.bincount(row, minlength=s.hi - s.lo), 1)
                f = np.bincount(row, weights=weights[bucket], minlength=s.hi - s.lo) / n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(f), pa.array(s.counts().astype(np.int64))], ["id", "f", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, "id long, f double, n_words long")


def quality_grades(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: int = 1, tail: float = 0.5, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """id, n_words, expected_grade, p_tail = P(grade >= cut), kept (p_tail >= tail): one row for each row of docs.

    grades: one (id, grade) per rated id, grades 0, 1, 2...; null ids and grades are left out. Null or
    wordless texts get the score of a text without evidence (f = 0) and are not kept. With fewer than
    two grades in the sample, grade and probability are null and every text with words is kept.
    """
    g = grades.select(F.col(grades.columns[0]).alias("_gid"), F.col(grades.columns[1]).alias("_grade")).where("_gid is not null and _grade is not null").groupBy("_gid").agg(F.max("_grade").alias("_grade"))
    model = fit(rated_features(docs, g, id_col, text_col, sample, bits), bits)
    if model is None:
        blank = Ordinal(np.zeros(1 << bits, np.float32), np.zeros(1))
        null = F.lit(None).cast("double")
        return linear_scores(docs, blank, id_col, text_col, bits).select(F.col("id").alias(id_col), "n_words", null.alias("expected_grade"), null.alias("p_tail"), (F.col("n_words") > 0).alias("kept"))
    above = lambda t: 1 / (1 + F.exp(F.lit(float(t)) - F.col("f")))  # noqa: E731  P(grade > k)
    expected: Column = sum((above(t) for t in model.cuts), F.lit(0.0))
    p = above(model.cuts[min(max(cut, 1), len(model.cuts)) - 1])
    return linear_scores(docs, model, id_col, text_col, bits).select(
        F.col("id").alias(id_col), "n_words", expected.alias("expected_grade"), p.alias("p_tail"), ((p >= tail) & (F.col("n_words") > 0)).alias("kept")
    )
