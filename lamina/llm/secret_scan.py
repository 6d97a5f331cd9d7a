"""Secrets in texts: fixed patterns, and a character network that looks at every other candidate.

Patterns (leftmost, not overlapping within a kind): an assignment to a secret-like name, an access key, a long
hexadecimal run. A candidate is any run of at least ``MIN_RUN`` characters of secrets, whatever it looks like. One
pass over the whole texts keeps patterns and candidates with their surroundings; all of them, labelled, fit a
convolutional network in numpy; a second pass scores every candidate of every document that no pattern covers.

The fit runs in tasks: different candidates are dealt to shards of about ``SHARD``, each of which begins at the shared
weights and goes over a part of its rows; after each of ``ROUNDS`` parts the weights are averaged by rows (in whole
numbers, so that the order of sums tells nothing). Rare secrets go to several shards, so that none lacks them.

The network embeds characters (those of the candidate apart from those around it), runs filters over them, takes
each filter's maximum and mean over the candidate and its maximum over the surroundings, and ends in two dense
layers. Labels: findings given by the caller, else the patterns' own findings as secrets and all other candidates as
none. As those labels must not teach the patterns back, a secret is also shown in the surroundings of plain words
and with its characters redrawn from other alphabets, and plain findings that a briefly fitted network
takes for secrets are left out of the fit. Scores are calibrated on a held-out fold; a finding
has a probability of ``CUT``, or of less where that is needed to keep ``RECALL`` of the fold's secrets.

Null texts are empty; texts without candidates have no spans; rows without doc_id or with a repeated one are scored
like any other; an empty table gives no rows; a corpus without labelled secrets (or nothing else) adds no spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_rows, forget, in_arrow, written
from .words import spread

# fixed values: the patterns of the base and the least length of what counts
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex")

LEARNT = "net"
MIN_RUN = 12
AROUND = 24  # characters kept on each side of a candidate
SHARD = 36_000  # labelled candidates that one task fits on, about
ROUNDS = 3  # times the weights of several shards are averaged in a pass
IN_SHARD = 50  # secrets that a shard has at least
PLAIN = 2.0  # weight of all other findings, to that of all secrets, at most
STEPS = 1 << 24, 1 << 10  # parts of one that weights are averaged in, and logits are counted in
RECALL = 0.98
CUT = 0.8  # calibrated probability that a finding has, unless RECALL asks for less
FOLDS, HELD_OUT = 5, 0
EPOCHS, DOUBT_EPOCHS, BATCH, RATE, SEED = 6, 1, 32, 0.004, 7
COMMON = 3, 3 / 4000  # plain findings of one shape, and their share, that make it a plain one
REDRAWN = 2  # times a secret is shown with characters of other alphabets
EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 16
SLICE_CHARS = 1 << 17
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(f"[0-9a-f]{{{MIN_HEX},}}")  # maximal runs, as the pattern with + finds them
_RUN = re.compile(f"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")


# ---- patterns and candidates --------------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of secret characters without the points and dashes at their ends, still of MIN_RUN or more."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        lo = m.start() + len(run) - len(run.lstrip(".-"))
        hi = m.end() - (len(run) - len(run.rstrip(".-")))
        if hi - lo >= MIN_RUN:
            out.append((lo, hi))
    return out


_SCANNED = "doc_id long, bases array<struct<start: long, kind: int, end: long>>, runs array<struct<start: long, end: long, covered: boolean, before: string, run: string, after: string>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("bases", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("covered", pa.bool_()), ("before", pa.string()), ("run", pa.string()), ("after", pa.string())]))),
])


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    bases = base_spans(text)
    runs, at, reach = [], 0, -1
    for lo, hi in candidates(text):
        while at < len(bases) and bases[at][0] < hi:
            reach = max(reach, bases[at][2])
            at += 1
        covered = reach > lo
        runs.append({"start": lo, "end": hi, "covered": covered, "before": text[max(0, lo - AROUND) : lo], "run": text[lo:hi], "after": text[hi : hi + AROUND]})
    return [{"start": s, "kind": k, "end": e} for s, k, e in bases], runs


def _scan_task(batches):
    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bases, runs = scan_text(text.as_py() or "")
            rows.append({"doc_id": doc, "bases": bases, "runs": runs})
            size += 1 + len(bases) + len(runs)
            if size > 20_000:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, bases, runs) of each document."""
    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scan_task, _SCANNED)


# ---- network ------------------------------------------------------------------------------------

_SYMBOLS = 97  # printable ASCII, and one for all else
_PAD = 2 * _SYMBOLS


def encode(before: list[str], run: list[str], after: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all samples in one row (padded by half a filter on each side), where each begins, and which are the candidate's."""
    pad = WIDTH // 2
    parts = [x for b, r, a in zip(before, run, after, strict=True) for x in (b, r, a)]
    raw = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(x) for x in parts], dtype=np.int64).reshape(-1, 3)
    symbol = np.where((raw >= 32) & (raw < 127), raw.astype(np.int64) - 32, _SYMBOLS - 1)
    inside = np.repeat(np.tile([False, True, False], len(size)), size.ravel())
    total = size.sum(1)
    first = np.cumsum(total + 2 * pad) - total - pad
    flat = np.full(int((total + 2 * pad).sum()), _PAD, dtype=np.int64)
    place = spread(first, total)
    flat[place] = symbol + _SYMBOLS * inside
    return flat, np.stack([first, size[:, 0], size[:, 1], size[:, 2]], 1), place


class Network:
    """Embedding, one convolution, maxima and means, a hidden layer, one output; plain numpy, trained by Adam."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": draw(2 * _SYMBOLS + 1, EMBED), "filter": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "hidden": draw(3 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1), "out_bias": np.zeros(1, np.float32)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def _windows(self, flat, place):
        return flat[place[:, None] + np.arange(-(WIDTH // 2), WIDTH // 2 + 1)]

    def forward(self, flat, at, place, keep: bool = False):
        """Logits; filters run over every character of the samples."""
        w = self.w
        windows = self._windows(flat, place)
        x = w["embed"][windows].reshape(len(place), -1)
        h = np.maximum(x @ w["filter"] + w["bias"], 0)
        size = at[:, 1:].ravel()
        edge = np.concatenate([[0], np.cumsum(size)])
        held = np.vstack([h, np.zeros((1, FILTERS), np.float32)])  # for empty surroundings at the end
        best = np.maximum.reduceat(held, edge[:-1], axis=0)
        best[size == 0] = 0  # reduceat gives the next row there
        best = best.reshape(-1, 3, FILTERS)
        mean = np.add.reduceat(held, edge[:-1], axis=0).reshape(-1, 3, FILTERS)[:, 1] / at[:, 2:3].astype(np.float32)
        pooled, around = [best[:, 1], mean], np.maximum(best[:, 0], best[:, 2])
        features = np.hstack([pooled[0], around, pooled[1]])
        hidden = np.tanh(features @ w["hidden"] + w["hidden_bias"])
        logit = (hidden @ w["out"] + w["out_bias"])[:, 0]
        return (logit, (windows, x, h, pooled, around, features, hidden)) if keep else logit

    def gradient(self, flat, at, place, label, weight=1.0):
        """Gradients of the mean logistic loss."""
        w, n = self.w, len(at)
        logit, (windows, x, h, pooled, around, features, hidden) = self.forward(flat, at, place, keep=True)
        d = ((1 / (1 + np.exp(-logit)) - label) * weight / n).astype(np.float32)[:, None]
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        d = (d @ w["out"].T) * (1 - hidden**2)
        g |= {"hidden": features.T @ d, "hidden_bias": d.sum(0)}
        d = d @ w["hidden"].T
        dh = np.zeros_like(h)
        size = at[:, 1:]
        sample = np.repeat(np.arange(n), size.sum(1))
        part = np.repeat(np.tile([0, 1, 0], n), size.ravel())
        inside = part == 1
        for rows, best, grad in ((inside, pooled[0], d[:, :FILTERS]), (~inside, around, d[:, FILTERS : 2 * FILTERS])):
            r = np.flatnonzero(rows)
            top = (h[r] == best[sample[r]]) & (h[r] > 0)
            share = np.zeros((n, FILTERS), np.float32)
            begin = np.flatnonzero(np.append(True, sample[r][1:] != sample[r][:-1])) if len(r) else r
            if len(r):  # a maximum reached at several places is shared by them
                share[sample[r][begin]] = np.add.reduceat(top.astype(np.float32), begin, axis=0)
            dh[r] += top * (grad / np.maximum(share, 1))[sample[r]]
        mean = d[:, 2 * FILTERS :] / np.maximum(size[:, 1:2], 1)
        dh[inside] += mean[sample[inside]]
        dh *= h > 0
        g |= {"filter": x.T @ dh, "bias": dh.sum(0)}
        dx = (dh @ w["filter"].T).reshape(-1, EMBED)
        at_symbol = windows.ravel()
        g["embed"] = np.stack([np.bincount(at_symbol, dx[:, e], len(w["embed"])) for e in range(EMBED)], 1).astype(np.float32)
        return g

    def fit(self, before, run, after, label, weight, epochs: int = EPOCHS, part: tuple[int, int] = (0, 1)):
        """Adam over ``epochs`` orders of the rows, of which the ``part`` (which, of how many) is seen; the weights are means over the later half of the steps."""
        rng = np.random.default_rng(SEED)
        mean, square, step = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        late, steps = np.zeros(len(self.flat())), epochs * -(-len(range(part[0], len(run), part[1])) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(run))[part[0] :: part[1]]
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                g = self.gradient(*encode([before[i] for i in pick], [run[i] for i in pick], [after[i] for i in pick]), label[pick], weight[pick])
                step += 1
                for k, v in g.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    self.w[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                if 2 * step > steps:
                    late += self.flat()
        if steps:
            self.put(late / (steps - steps // 2))

    def logits(self, before, run, after) -> np.ndarray:
        """In slices of bounded text, whole candidates whatever their length: a longer one is a slice of its own, cut for the filters."""
        out = np.empty(len(run), np.float32)
        size = np.cumsum([len(b) + len(r) + len(a) for b, r, a in zip(before, run, after, strict=True)])
        lo = 0
        while lo < len(run):
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + SLICE_CHARS, side="right")))
            out[lo:hi] = self.forward(*encode(before[lo:hi], run[lo:hi], after[lo:hi]))
            lo = hi
        return out

    def probability(self, before, run, after) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(before, run, after) + self.shift, -60, 60)))

    def calibrate(self, logit: np.ndarray, label: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> None:
        """Scale and shift of the logits by Newton steps on the held-out fold (with targets drawn in a little), then the threshold."""
        weight = np.ones(len(logit)) if weight is None else weight
        yes, no = max(1.0, float(weight[label == 1].sum())), max(1.0, float(weight[label == 0].sum()))
        target = np.where(label == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
        x, beta = np.stack([logit, np.ones_like(logit)], 1).astype(np.float64), np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
            move = np.linalg.solve(hess, x.T @ (weight * (target - p)))
            beta += np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-9:
                break
        self.scale, self.shift = float(beta[0]), float(beta[1])
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))[label == 1]
        order = np.argsort(p)
        upto = np.cumsum(weight[label == 1][order])
        self.threshold = min(CUT, float(p[order][np.searchsorted(upto, np.floor((1 - RECALL) * upto[-1]), side="right")]))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n


# ---- training -----------------------------------------------------------------------------------


_ROW = "h: long, label: int, before: string, run: string, after: string"


def labelled(rows: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(label, run, before, after, h): every different labelled candidate, with the hash that gives its fold.

    ``findings`` has (doc_id, start, end, secret); without it a candidate that a pattern covers is a secret. Runs of
    digits only are left out of the secrets, as are runs of over 1,000 characters.
    """
    each = rows.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").where(F.length("run") <= 1000)
    if findings is None:
        each = each.withColumn("label", F.when(~F.col("covered"), 0).when(~F.col("run").rlike("^[0-9]+$"), 1))
    else:
        each = each.join(findings.select("doc_id", "start", "end", F.col("secret").cast("int").alias("label")).distinct(), ["doc_id", "start", "end"])
    # equal candidates count once
    once = each.where("label is not null").groupBy("label", "run").agg(F.min(F.struct("before", "after")).alias("c"))
    return once.select("label", "run", "c.before", "c.after", F.xxhash64("run").alias("h"))


def dealt(once: DataFrame, n: int, secrets_: int, shard: int = SHARD) -> DataFrame:
    """(shard, rows): a row for each shard; secrets go to several where shards would have fewer than IN_SHARD, to all at most."""
    shards = -(-n // shard)
    copies = max(1, min(shards, -(-IN_SHARD * shards // max(1, secrets_))))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies - 1).otherwise(0)))
    rows = once.withColumn("copy", copy).withColumn("shard", F.pmod(F.pmod(F.xxhash64(F.lit(1), "run"), F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "shard")  # by number, or small shards end up in one task
    return rows.groupBy("shard").agg(F.collect_list(F.struct("h", "label", "before", "run", "after")).alias("rows"))


def _sample(rows) -> list:
    """(fold, label, before, run, after) of a shard, in an order that does not hang on how rows came."""
    each = sorted(zip(*(rows.field(c).to_pylist() for c in ("h", "label", "before", "run", "after")), strict=True))
    return [(h % FOLDS, *row) for h, *row in each]


def _shards(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].values


def shown(sample: list, rng: np.random.Generator, redraw: bool) -> tuple[list, list, list, np.ndarray, np.ndarray]:
    """The sample as weighted training rows: each as it stands, and each secret in the surroundings of plain words and the other way round."""
    plain = [s for s in sample if s[1] == 0]
    secret = [s for s in sample if s[1] == 1]
    rows = [(b, r, a, y) for _, y, b, r, a in sample if y == 0]
    weight = [min(1.0, PLAIN * len(secret) / len(plain))] * len(rows)
    for _, _, before, run, after in secret:
        if not redraw:
            other = plain[rng.integers(len(plain))]
            rows.append((other[2], run, other[4], 1))
            continue
        rows.append((before, run, after, 1))
        # a short name and its sign before the secret may stay; the rest is that of a plain word
        value = re.split(r"[=:\"']", run)[-1] or run
        for alphabet in (None, *(ALPHABETS[rng.integers(len(ALPHABETS))] for _ in range(REDRAWN))):
            other = plain[rng.integers(len(plain))]
            if alphabet is not None:
                value = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=max(16, len(value))))
            rows.append((other[2], value, other[4], 1))
    if redraw:
        for k in rng.permutation(len(plain))[: len(secret)]:
            other = secret[rng.integers(len(secret))]
            rows.append((other[2], plain[k][3], other[4], 0))
    before, run, after, y = zip(*rows, strict=True)
    return list(before), list(run), list(after), np.array(y), np.array(weight + [1.0] * (len(rows) - len(weight)))


def fitted(shards: DataFrame, n: int, rows: int, epochs: int, folds: set[int]) -> Network:
    """A network fitted on all ``rows`` rows of ``folds`` in n shards: ``epochs`` passes of one shard, as far as SHARD asks for them, or one pass of several in ROUNDS parts."""
    net = Network()
    rounds, passes = (1, max(1, min(epochs, -(-SHARD // max(1, rows))))) if n == 1 else (ROUNDS, 1)

    def task(part):
        def run(batches):
            for shard, rows in _shards(batches):
                sample = [s for s in _sample(rows) if s[0] in folds]
                if {s[1] for s in sample} == {0, 1}:
                    own = Network()
                    own.put(net.flat())
                    own.fit(*shown(sample, np.random.default_rng((SEED, shard)), True), epochs=passes, part=part)
                    value = np.rint(own.flat().astype(np.float64) * STEPS[0]).astype(np.int64) * len(sample)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value) + 1, dtype=np.int32)), pa.array(np.append(value, len(sample)))], ["i", "v"])

        return run

    for k in range(rounds):
        with batch_rows(shards.sparkSession, 1):
            total = in_arrow(shards, task((k, rounds)), "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i").column("v").to_numpy()
        if len(total):
            net.put(total[:-1] / total[-1] / STEPS[0])
    return net


def _shape(run: str) -> str:
    return re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", run)))


def common_shapes(once: DataFrame, plain: int) -> set[str]:
    """Shapes (kinds of characters in turn) of at least COMMON plain findings; a share bounds their number."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("run", "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    many = once.where("label = 0").groupBy(shape.alias("shape")).agg(F.count("*").alias("n")).where(F.col("n") >= max(COMMON[0], COMMON[1] * plain))
    return {r.shape for r in many.collect()}


def without_doubts(shards: DataFrame, net: Network, common: set[str]) -> DataFrame:
    """The shards less the plain findings that a briefly fitted network takes for secrets.

    Patterns know no other secrets, so some of what they leave as plain is not; few steps do not learn single rows.
    A shape that many plain findings share is plain all the same: addresses, dates.
    """

    def run(batches):
        for shard, rows in _shards(batches):
            logit = net.logits(*(rows.field(c).to_pylist() for c in ("before", "run", "after")))
            sure = np.array([_shape(r) in common if z >= 0 and y == 0 else True for r, z, y in zip(rows.field("run").to_pylist(), logit, rows.field("label").to_pylist(), strict=True)], bool)
            kept = rows.filter(pa.array(sure))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)], ["shard", "rows"])

    return in_arrow(shards, run, f"shard int, rows array<struct<{_ROW}>>")


def held_logits(shards: DataFrame, net: Network) -> DataFrame:
    """(label, step, n): logits of the held-out fold as it is shown, counted by steps."""

    def run(batches):
        for shard, rows in _shards(batches):
            sample = [s for s in _sample(rows) if s[0] == HELD_OUT]
            if any(s[1] == 0 for s in sample):
                before, run_, after, label, _ = shown(sample, np.random.default_rng((SEED, shard)), False)
                step = np.floor(np.clip(net.logits(before, run_, after), -60, 60) * STEPS[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(step)], ["label", "step"])

    return in_arrow(shards, run, "label int, step long").groupBy("label", "step").agg(F.count("*").alias("n"))


def trained(once: DataFrame, sure: bool = False, shard: int = SHARD) -> Network | None:
    """A network fitted on four folds of all labelled candidates and calibrated on the fifth; None where a label is missing in either.

    Unless the labels are ``sure``, plain findings that look like secrets are left out first.
    """
    spark = once.sparkSession
    n = {r.label: r.n for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return None
    parts = -(-sum(n.values()) // shard)
    with batch_rows(spark, 1):
        shards = written(dealt(once, sum(n.values()), n[1], shard), "secret-shards")
        if not sure:
            brief = fitted(shards, parts, sum(n.values()), DOUBT_EPOCHS, set(range(FOLDS)))
            every, shards = shards, written(without_doubts(shards, brief, common_shapes(once, n[0])), "secret-shards")
            forget(every)
    have = shards.select(F.explode("rows").alias("r")).groupBy((F.pmod("r.h", F.lit(FOLDS)) == HELD_OUT).alias("held"), "r.label").agg(F.count("*").alias("n")).collect()
    if len(have) < 4:
        return None
    net = fitted(shards, parts, sum(r.n for r in have if not r.held), EPOCHS, set(range(FOLDS)) - {HELD_OUT})
    with batch_rows(spark, 1):
        t = held_logits(shards, net).toArrow()
    forget(shards)
    label, weight = t.column("label").to_numpy(), t.column("n").to_numpy().astype(np.float64)
    if {*label.tolist()} != {0, 1}:
        return None
    weight[label == 0] *= min(1.0, PLAIN * weight[label == 1].sum() / weight[label == 0].sum())
    net.calibrate(t.column("step").to_numpy() / STEPS[1], label, weight=weight)
    return net


# ---- scoring ------------------------------------------------------------------------------------

_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_net", pa.int64())])


def _score_task(net: Network | None):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found: list[list[tuple[int, int, int]]] = [[] for _ in rows]
            open_ = [(i, r) for i, row in enumerate(rows) for r in row["runs"] if not r["covered"]]
            if net is not None and open_:
                p = net.probability(*([r[c] for _, r in open_] for c in ("before", "run", "after")))
                for k in np.flatnonzero(p >= net.threshold):
                    i, r = open_[k]
                    found[i].append((r["start"], len(KINDS), r["end"]))
            out = []
            for row, more in zip(rows, found, strict=True):
                bases = [(b["start"], b["kind"], b["end"]) for b in row["bases"]]
                text = lambda spans: ",".join(f"{(*KINDS, LEARNT)[k]}:{s}:{e}" for s, k, e in sorted(spans))
                n = [sum(k == kind for _, k, _ in bases) for kind in range(len(KINDS))]
                out.append((row["doc_id"], *n, hashlib.sha256(text(bases).encode()).hexdigest(), text(bases + more), len(more)))
            columns = list(zip(*out, strict=True)) or [[] for _ in _OUT_ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT_ARROW, strict=True)], schema=_OUT_ARROW)

    return run


def secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net): a row for each document with all its spans."""
    rows = written(scanned(docs), "secret-scan")
    once = written(labelled(rows, findings), "secret-labels")
    net = trained(once, sure=findings is not None)
    forget(once)
    return in_arrow(rows, _score_task(net), _OUT)
