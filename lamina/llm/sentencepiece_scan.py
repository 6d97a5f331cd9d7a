"""SentencePiece encoding and decoding by a max-plus parallel scan.

The segmentation of a text is the one of greatest total piece score (the unigram objective over the
model's pieces and scores; of equal ones, the longest last piece, then the longest before it...), with
byte pieces for characters without a piece. A text is encoded as a space and itself, spaces as U+2581.

Giant texts are split into chunks of CHUNK characters at any place. A state at a chunk's boundary is
the number of characters by which a piece overhangs it. Each chunk yields a transfer matrix (best
score from each entry state to each exit state) under max and plus, which is associative; their
prefix products give the exact best score of each boundary state, and with these each chunk is
backtraced on its own. The ids equal those of one pass over the whole text.

Where no piece holds a space after another character, every best path is cut before such a space.
Inside such cuts a segment is encoded once and kept in a bounded cache, and a matrix only needs the
parts before a chunk's first and after its last cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SegmentCache, text_ids
from .shared import in_arrow
from .words import mix, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536
DECODE_IDS = 300_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed: below the least piece score
LOW = -1e18


@dataclass
class Vocabulary:
    """Piece strings to (id, score), byte ids and each id's bytes."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    raw: list[bytes]
    longest: int = field(init=False)
    unknown: float = field(init=False)
    cuts_at_space: bool = field(init=False)
    beginnings: dict = field(init=False)  # of pieces; None where one is no piece itself

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.beginnings = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_, raw = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            pieces[p] = (i, sp.get_score(i))
            raw.append(p.replace(SPACE, " ").encode())
    return Vocabulary(pieces, bytes_, raw)


class Lattice:
    """Best scores of the cuts of a string, from given scores of some of them."""

    def __init__(self, v: Vocabulary, s: str, entry: dict[int, float], starts: int):
        """``starts``: pieces begin at cuts before this one; they may end up to the end of s."""
        n = len(s)
        best, back = [LOW] * (n + 1), [-1] * (n + 1)
        for i, x in entry.items():
            best[i] = x
        get, longest, unknown = v.beginnings.get, v.longest, v.unknown
        for i in range(min(starts, n)):
            x = best[i]
            if x <= LOW:
                continue
            single = False
            for j in range(i + 1, min(i + longest, n) + 1):
                p = get(s[i:j], False)
                if p is False:  # no piece begins like this
                    break
                if p is not None:
                    single |= j == i + 1
                    if x + p[1] > best[j]:
                        best[j], back[j] = x + p[1], i
            if not single and x + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = x + unknown, i
        self.v, self.s, self.best, self.back = v, s, best, back

    def path(self, end: int) -> tuple[int, list[int]]:
        """The entry cut of the best path to ``end`` and its ids."""
        spans = []
        while self.back[end] >= 0:
            spans.append((self.back[end], end))
            end = self.back[end]
        ids: list[int] = []
        for a, b in reversed(spans):
            p = self.v.pieces.get(self.s[a:b])
            if p is not None:
                ids.append(p[0])
            else:
                ids.extend(self.v.bytes_[x] for x in self.s[a:b].encode("utf-8", "surrogatepass"))
        return end, ids


def encode_text(v: Vocabulary, normal: str) -> list[int]:
    """One pass over a normalised string."""
    return Lattice(v, normal, {0: 0.0}, len(normal)).path(len(normal))[1]


class Together:
    """Segments of one length encoded together: the same best path as :class:`Lattice`, for many rows at once.

    Pieces of each length are found by 64-bit hashes of their code points. Lengths with few segments,
    and segments with a character that has no piece, are encoded one by one.
    """

    FEW = 12
    CELLS = 1 << 16

    def __init__(self, v: Vocabulary):
        self.v = v
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list] = {}
        for p, (i, score) in v.pieces.items():
            by_size.setdefault(len(p), []).append((p, i, score))
        for n, group in by_size.items():
            key = self._hashes(_points("".join(p for p, _, _ in group)).reshape(-1, n), n)[:, 0]
            order = np.argsort(key)
            self.tables[n] = key[order], np.array([i for _, i, _ in group], np.int32)[order], np.array([x for _, _, x in group])[order]

    @staticmethod
    def _hashes(points: np.ndarray, n: int) -> np.ndarray:
        """A hash for each run of n code points of each row."""
        h = np.zeros((points.shape[0], points.shape[1] - n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + points[:, k : k + h.shape[1]]
        return mix(h)

    def _equal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of rows of equal length; a count of -1 where a character has no piece."""
        rows, n = points.shape
        best, size, piece = np.full((rows, n + 1), LOW), np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
        best[:, 0] = 0.0
        found = {}
        bare = np.zeros(rows, bool)
        for k in range(1, min(n, self.v.longest) + 1):
            if k in self.tables:
                key, ids, score = self.tables[k]
                h = self._hashes(points, k)
                at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                hit = key[at] == h
                found[k] = np.where(hit, score[at], 2 * LOW), ids[at]
                if k == 1:
                    bare = ~hit.all(axis=1)
        for j in range(1, n + 1):
            for k in range(min(j, self.v.longest), 0, -1):  # of equal totals the longest last piece
                if k in found:
                    score, ids = found[k]
                    x = best[:, j - k] + score[:, j - k]
                    up = x > best[:, j]
                    best[up, j], size[up, j], piece[up, j] = x[up], k, ids[up, j - k]
        at, used = np.full(rows, n), np.zeros((rows, n), bool)
        live = np.flatnonzero(~bare)
        while len(live):
            used[live, at[live] - 1] = True
            at[live] -= size[live, at[live]]
            live = live[at[live] > 0]
        return piece[:, 1:][used], np.where(bare, -1, used.sum(axis=1))

    def __call__(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = [b.decode("utf-8", "replace").replace(" ", SPACE) for b in segments]
        length = np.fromiter(map(len, text), np.int64, len(text))
        count = np.zeros(len(text), np.int64)
        owner, parts, single = [], [], []
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n = int(length[group[0]])
            if n == 0 or len(group) < self.FEW:
                single.extend(group.tolist())
                continue
            step = max(self.FEW, self.CELLS // n)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                ids, many = self._equal(_points("".join(text[i] for i in part.tolist())).reshape(-1, n))
                single.extend(part[many < 0].tolist())
                count[part] = np.maximum(many, 0)
                parts.append(ids)
                owner.append(np.repeat(part, count[part]))
        for i in single:
            ids = np.array(encode_text(self.v, text[i]), np.int32)
            count[i] = len(ids)
            parts.append(ids)
            owner.append(np.full(len(ids), i))
        if not parts:
            return np.zeros(0, np.int32), count
        return np.concatenate(parts)[np.argsort(np.concatenate(owner), kind="stable")], count


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def forced_cuts(v: Vocabulary, s: str) -> list[int]:
    """Cuts inside s that every path has: before a space that follows another character."""
    if not v.cuts_at_space:
        return []
    out, i = [], s.find(SPACE, 1)
    while i > 0:
        if s[i - 1] != SPACE:
            out.append(i)
        i = s.find(SPACE, i + 1)
    return out


class Chunk:
    """A chunk's characters and those that its last piece may reach. Pieces begin in the first ``own`` characters."""

    def __init__(self, v: Vocabulary, s: str, own: int, segment):
        self.v, self.s, self.own, self.segment = v, s, own, segment
        self.width = v.longest  # states 0..longest-1; longest is enough for any overhang
        self.cuts = [c for c in forced_cuts(v, s) if c < own]

    def _ends(self, lat: Lattice, shift: int) -> np.ndarray:
        out = np.full(self.width, LOW)
        for b in range(self.width):
            j = self.own + b - shift
            if 0 <= j < len(lat.best):
                out[b] = lat.best[j]
        return out

    def matrix(self) -> np.ndarray:
        """score[entry, exit] under max and plus."""
        t = np.full((self.width, self.width), LOW)
        head_end = self.cuts[0] if self.cuts else None
        tail = middle = None
        if self.cuts:
            last = self.cuts[-1]
            tail = self._ends(Lattice(self.v, self.s[last:], {0: 0.0}, self.own - last), last)
            middle = sum(self.segment(self.s[a:b])[1] for a, b in zip(self.cuts, self.cuts[1:], strict=False))
        for a in range(min(self.width, len(self.s) + 1)):
            if head_end is None:
                t[a] = self._ends(Lattice(self.v, self.s, {a: 0.0}, self.own), 0)
            elif a <= head_end:
                head = Lattice(self.v, self.s[:head_end], {a: 0.0}, head_end).best[head_end]
                t[a] = np.where(tail > LOW, head + middle + tail, LOW) if head > LOW else LOW
        return t

    def paths(self, entry: np.ndarray) -> tuple[list[int], dict[int, tuple[int, list[int]]]]:
        """Ids that all paths share after their entry, and for each exit state its entry state and other ids.

        entry: the exact best score of each entry state, so that ties break as in one pass.
        """
        given = {a: float(x) for a, x in enumerate(entry) if x > LOW / 2 and a <= len(self.s)}
        if not self.cuts:
            lat = Lattice(self.v, self.s, given, self.own)
            return [], {b: lat.path(self.own + b) for b in range(self.width) if self.own + b <= len(self.s) and lat.best[self.own + b] > LOW / 2}
        first, last = self.cuts[0], self.cuts[-1]
        start, ids = Lattice(self.v, self.s[:first], {a: x for a, x in given.items() if a <= first}, first).path(first)
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            ids.extend(self.segment(self.s[a:b])[0])
        tail = Lattice(self.v, self.s[last:], {0: 0.0}, self.own - last)
        ends = range(max(0, last - self.own), min(self.width, len(self.s) - self.own + 1))
        return ids, {b: (start, tail.path(self.own + b - last)[1]) for b in ends if tail.best[self.own + b - last] > LOW / 2}


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


def entry_scores(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The best score of each entry state of each chunk: row 0 of the exclusive prefix products, by a doubling scan."""
    width = matrices[0].shape[0]
    one = np.where(np.eye(width, dtype=bool), 0.0, LOW)
    scan, step = list(matrices), 1
    while step < len(scan):
        scan = [max_plus(scan[i - step], m) if i >= step else m for i, m in enumerate(scan)]
        step *= 2
    return [p[0] for p in [one, *scan[:-1]]]


def _segments(v: Vocabulary):
    memo: dict[str, tuple[list[int], float]] = {}

    def segment(s: str) -> tuple[list[int], float]:
        got = memo.get(s)
        if got is None:
            if len(memo) > 200_000:
                memo.clear()
            lat = Lattice(v, s, {0: 0.0}, len(s))
            got = memo[s] = (lat.path(len(s))[1], lat.best[len(s)])
        return got

    return segment


def _cuts(v: Vocabulary):
    def cuts(buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Row starts and spaces after other characters (of the plain text; a row's first space belongs to the added one)."""
        n = len(buf)
        ok = np.zeros(n, dtype=bool)
        inner = rows[:-1][rows[:-1] < n]
        if v.cuts_at_space and n > 1:
            space = buf == 0x20
            # U+2581 in a text is read as a space
            literal = np.zeros(n, dtype=bool)
            literal[2:] = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)
            ok[1:] = space[1:] & ~space[:-1] & ~literal[:-1]
        ok[inner] = True
        return np.flatnonzero(ok)

    return cuts


DIGESTS = ["n_chars", "text_hash"]


class Decoder:
    """Bytes of ids from one pool of all pieces' bytes."""

    def __init__(self, raw: list[bytes]):
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def texts(self, ids: np.ndarray, at: np.ndarray):
        """The text of each row of ids, without the added space; a bounded number of ids at a time, a longer row alone."""
        lo = 0
        while lo < len(at) - 1:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + DECODE_IDS, side="right")) - 1)
            part = ids[at[lo] : at[hi]]
            count = self.size[part]
            data = self.pool[spread(self.first[part], count)].tobytes()
            ends = np.concatenate([[0], np.cumsum(count)])[at[lo : hi + 1] - at[lo]]
            for a, b in zip(ends, ends[1:], strict=False):
                yield data[a + 1 : b].decode("utf-8", "replace") if b > a else ""
            lo = hi

    def digests(self, ids: np.ndarray, at: np.ndarray) -> list:
        """Code points and a 64-bit hash of each decoded text."""
        import pyarrow as pa
        import xxhash

        n, h = [], []
        for t in self.texts(ids, at):
            n.append(len(t))
            h.append(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")))
        return [pa.array(n, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64))]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """id and ids (array<int>) for each row of docs. Null and empty texts have no ids; null ids and repeated rows stay.

    Texts of up to ``chunk`` characters are encoded where they are read; longer ones go through the scan.
    """
    short, giant = _short_and_giant(docs, id_col, text_col, model, chunk, False)
    return short.union(giant)


def _short_and_giant(docs: DataFrame, id_col: str, text_col: str, model: str, chunk: int, digests: bool) -> tuple[DataFrame, DataFrame]:
    """(id, ids) of the texts of either size; the short ones with digests of their decoded text if asked for."""
    v = load(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    small = F.length(F.coalesce("text", F.lit(""))) <= chunk
    decoder = Decoder(v.raw)

    def whole(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        # The first segment of a row has the added space: its bytes get one more in front.
        cache = SegmentCache(Together(v))
        cuts = _cuts(v)
        for batch in batches:
            given = pc.fill_null(batch.column(1), "")
            text = pc.if_else(pc.equal(given, ""), "", pc.binary_join_element_wise(" ", given, ""))
            for lo, hi, ids, at in text_ids(text, cuts, cache, 1 << 20):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                more = decoder.digests(ids, at) if digests else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, *more], ["id", "ids", *DIGESTS[: len(more)]])

    short = rows.where(small).transform(in_arrow, whole, "id long, ids array<int>" + (", n_chars long, text_hash long" if digests else ""))
    return short, encode_giant(rows.where(~small), v, chunk)


def _by_text(step, out):
    """Runs ``step(list of rows)`` for each run of equal ``row`` in sorted batches."""

    def run(batches):
        import pyarrow as pa

        held, at = [], None

        def flush():
            cols = step(held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: a batch's ids as Python lists would be large
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held and r["row"] != at:
                    yield flush()
                    held = []
                at = r["row"]
                held.append(r)
        if held:
            yield flush()

    return run


def encode_giant(rows: DataFrame, v: Vocabulary, chunk: int) -> DataFrame:
    """The scan over (id, text) rows: one record a chunk; a text's records meet only as matrices and as ids."""
    import pyarrow as pa

    from .shared import written

    over = v.longest
    full = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    parts = rows.withColumn("row", F.expr("uuid()")).withColumn("s", full).withColumn("n", F.length("s"))
    parts = parts.select("row", "id", "s", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)).alias("k"))
    parts = parts.select("row", "id", "k", F.least(F.lit(chunk), F.col("n") - F.col("k") * chunk).alias("own"), F.substring("s", F.col("k") * chunk + 1, F.lit(chunk + over)).alias("s"))
    parts = written(parts, "chunks")  # the row keys must not be drawn again

    def matrices(batches):
        segment = _segments(v)
        for batch in batches:
            out = [Chunk(v, s, own, segment).matrix().tobytes() for s, own in zip(batch.column("s").to_pylist(), batch.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(out, pa.binary())], ["row", "k", "m"])

    def scan(held):
        mats = [np.frombuffer(r["m"]).reshape(v.longest, v.longest) for r in held]
        return [[r["row"] for r in held], [r["k"] for r in held], [e.tobytes() for e in entry_scores(mats)]]

    step = pa.schema([("row", pa.string()), ("k", pa.int32()), ("entry", pa.binary())])
    entries = (
        parts.select("row", "k", "own", "s").transform(in_arrow, matrices, "row string, k int, m binary").repartition("row").sortWithinPartitions("row", "k").transform(in_arrow, _by_text(scan, step), "row string, k int, entry binary")
    )

    exits = pa.list_(pa.struct([("exit", pa.int32()), ("entry", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    def backtrace(batches):
        segment = _segments(v)
        for batch in batches:
            shared, ends = [], []
            for s, own, e in zip(*(batch.column(c).to_pylist() for c in ("s", "own", "entry")), strict=True):
                ids, ex = Chunk(v, s, own, segment).paths(np.frombuffer(e))
                shared.append(ids)
                ends.append([{"exit": b, "entry": a, "ids": x} for b, (a, x) in ex.items()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("k"), pa.array(shared, pa.list_(pa.int32())), pa.array(ends, exits)], ["row", "id", "k", "shared", "exits"])

    def join_up(held):
        state, out = 0, []
        for r in reversed(held):  # a text ends at state 0; each chunk names the state it was entered in
            end = next(x for x in r["exits"] if x["exit"] == state)
            out.append([*r["shared"], *end["ids"]])
            state = end["entry"]
        return [[held[0]["id"]], [[x for ids in reversed(out) for x in ids]]]

    traced = parts.join(entries, ["row", "k"]).transform(in_arrow, backtrace, "row string, id long, k int, shared array<int>, exits array<struct<exit:int,entry:int,ids:array<int>>>")
    last = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return traced.repartition("row").sortWithinPartitions("row", "k").transform(in_arrow, _by_text(join_up, last), "id long, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL, columns: tuple[str, ...] = ("id",), digests: bool = False) -> DataFrame:
    """The columns named, and the text of ``ids`` (or its digests): piece by piece, without the added space. Bytes that are no UTF-8 become U+FFFD."""
    decoder = Decoder(load(model).raw)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(columns))
            ids, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = decoder.digests(ids, at) if digests else [pa.array(list(decoder.texts(ids, at)), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *out], [*columns, *(DIGESTS if digests else ["text"])])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, F.coalesce("ids", F.array().cast("array<int>")).alias("_ids")).transform(in_arrow, run, types + (", n_chars long, text_hash long" if digests else ", text string"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """id, n_tokens, ids, and the code points (n_chars) and 64-bit hash (text_hash) of what the ids decode to."""
    short, giant = _short_and_giant(docs, id_col, text_col, model, chunk, True)
    out = short.union(decode(giant, model, ("id", "ids"), digests=True))
    return out.select(F.col("id").alias(id_col), F.size("ids").alias("n_tokens"), "ids", "n_chars", "text_hash")
