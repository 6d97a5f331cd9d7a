"""MinHash near-duplicate detection with tensored banding.

Two small collections of ``m`` group hashes (each over ``r`` minhashes) are computed per text, and
every pair (i, j) of a group of the first and a group of the second keys one of ``m * m`` tables of
``2 r`` minhashes. So 2*m*r minhashes serve m*m tables; at m=16, r=5 a pair of Jaccard 0.85 shares a
key with probability 0.9998, one of 0.3 with 0.0015.

Steps, all distributed:

1. One pass over the texts: size and fingerprint of the shingle set, and 2*m group hashes.
2. Equal sets form a class (aggregated before the shuffle), so groups of exact copies count once.
3. A table row can only meet another if both its groups do, so the m*m rows are made for classes and
   groups that meet another class in a collection; the rest cost 2*m rows.
4. In each table a key's smallest member is its pivot; every member is linked to the pivot if their
   full sets are similar enough. This is linear in the table, whatever the size of a bucket. A pair
   that meets in many tables is one row from here on, with the groups of the first collection in
   which it met (m at most).
5. Components of the links so far. Where a pivot and a member of its bucket are not connected, the
   group of the first collection that they share stays open. All open groups get new pivots, ROUNDS
   times, and what these connect drops out.
6. In groups that still have several components, the pairs that cross components are compared, in
   blocks of bounded size, so no candidate goes unchecked. A bit sketch of each set bounds the
   symmetric difference from below, so it only drops pairs that cannot reach the limit; the others
   are verified on their full sets.

Links inside one component need no check, as they cannot change the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bloom, components, forget, free_name, in_arrow, in_bloom, small, written
from .words import mix, shingles, slices

GROUPS = 16
ROWS = 5
SHINGLE = 5


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """id, n_shingles, fingerprint (fp1, fp2) of the distinct shingles, and 2*groups group hashes (null for an empty set)."""
    rng = np.random.default_rng(20240117)
    mult = rng.integers(0, 2**31, 2 * groups * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, 2 * groups * rows, dtype=np.uint32)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in slices(batch.column(1)):
                h, at = shingles(s, size)
                n_rows = s.hi - s.lo
                n, f1, f2 = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
                for i in range(n_rows):
                    u = np.unique(h[at[i] : at[i + 1]])
                    n[i] = len(u)
                    f1[i] = mix(u).sum(dtype=np.uint64)
                    f2[i] = mix(u ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
                full = np.flatnonzero(n)
                keys = np.zeros((n_rows, 2 * groups), np.uint64)
                if len(full):
                    first = at[full]
                    half = (h >> np.uint64(32)).astype(np.uint32)
                    with np.errstate(over="ignore"):
                        for g in range(2 * groups):
                            acc = np.full(len(full), g + 1, np.uint64)
                            for r in range(rows):
                                k = g * rows + r
                                x = half * mult[k]
                                x += add[k]
                                x ^= x >> np.uint32(16)
                                x *= np.uint32(0x7FEB352D)
                                acc = mix(acc + np.minimum.reduceat(x, first).astype(np.uint64))
                            keys[full, g] = acc
                flat = pa.array(keys.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * 2 * groups, pa.int32()), flat, mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, n_rows), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists],
                    ["id", "n_shingles", "fp1", "fp2", "groups"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, 
        run, "id long, n_shingles long, fp1 long, fp2 long, groups array<long>"
    )


def shingle_sets(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, set): the distinct shingle hashes of the rows whose id may be in the filter ``wanted``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            hit = in_bloom(wanted, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            for s in slices(batch.column(1)):
                h, at = shingles(s, size)
                sets = [np.unique(h[at[i] : at[i + 1]]).view(np.int64) for i in range(s.hi - s.lo)]
                bounds = np.concatenate([[0], np.cumsum([len(u) for u in sets])])
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(np.concatenate(sets))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), lists], ["id", "set"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, "id long, set array<long>")


SKETCH_BITS = 4096
BLOCK = 1024
ROUNDS = 2
HOT_PAIRS = 512  # pairs of one text that meet its set in one place


def sketches(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, sketch): the parity of the shingle hashes in each of SKETCH_BITS cells.

    The bits in which two sketches differ are at most as many as the shingles that only one set has.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            hit = in_bloom(wanted, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            for s in slices(batch.column(1)):
                h, at = shingles(s, size)
                out = []
                for i in range(s.hi - s.lo):
                    cells = np.bincount((np.unique(h[at[i] : at[i + 1]]) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
                    out.append(np.packbits((cells & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(out, pa.binary())], ["id", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, "id long, sketch binary")


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one bucket and different components whose sketches allow the limit.

    rows: key, i, j, block, rep, n, comp, sketch; each (key, i, j) holds two blocks at most.
    """

    def compare(block, rep, n, comp, bits, i, j):
        order = np.argsort(block, kind="stable")
        rep, n, comp, bits, block = rep[order], n[order], comp[order], bits[order], block[order]
        split = len(rep) if i == j else int(np.searchsorted(block, j))
        for x in range(len(rep) if i == j else split):
            lo = x + 1 if i == j else split
            other = np.arange(lo, len(rep))
            most = np.maximum(n[other], n[x])
            other = other[(comp[other] != comp[x]) & (rep[other] != rep[x]) & (100 * np.minimum(n[other], n[x]) >= percent * most)]
            if len(other):
                apart = np.bitwise_count(bits[other] ^ bits[x]).sum(axis=1, dtype=np.int64)
                ok = other[apart * (100 + percent) <= (100 - percent) * (n[other] + n[x])]
                if len(ok):
                    yield np.minimum(rep[ok], rep[x]), np.maximum(rep[ok], rep[x])

    def run(batches):
        import pyarrow as pa

        def flush(group):
            t = pa.Table.from_batches(group)
            col = {k: t.column(k).to_numpy() for k in ("block", "rep", "n", "comp")}
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(t), -1)
            got = list(compare(col["block"], col["rep"], col["n"], col["comp"], bits, t.column("i")[0].as_py(), t.column("j")[0].as_py()))
            if got:
                a, b = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("key", "i", "j")], axis=1)
            if not len(keys):
                continue
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
                if at is not None and tuple(keys[lo]) != at:
                    yield from flush(held)
                    held = []
                at = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush(held)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").transform(in_arrow, run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full shingle sets have 100*|∩| >= percent*|∪|."""
    wanted = bloom(pairs.select("a").union(pairs.select("b")), "a")
    sets = shingle_sets(docs, wanted, id_col, text_col, size)
    hot = pairs.groupBy("a").count().where(F.col("count") > HOT_PAIRS).select("a", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("parts"))
    hot = small(written(hot, "hot"))  # a set that many pairs need goes to several places
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    left = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).join(hot, "a", "left").select("a", "set_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = left.join(right, ["a", "part"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common >= percent * total).select("a", "b").distinct()


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    groups: int = GROUPS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> DataFrame:
    """id, n_shingles, component_id, kept for every row.

    Null or wordless texts have an empty set and are linked with nothing. Rows with a null id are
    kept with a null component. Rows that share an id are one node: each has its own n_shingles and
    all have the id's component. An empty table gives an empty result; other columns are ignored.
    """
    sigs = written(signatures(docs, id_col, text_col, groups, rows, size), "signatures")
    known = sigs.where("id is not null")
    classes = written(
        known.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("id").alias("rep"), F.any_value("groups").alias("groups")),
        "classes",
    )
    alone = classes.select("rep", F.posexplode("groups").alias("i", "x"))
    meet = alone.groupBy("i", "x").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 <> r1").select("i", "x")
    met = alone.join(meet, ["i", "x"]).groupBy("rep").agg(F.collect_list(F.struct("i", "x")).alias("met"))  # 2*groups at most
    side = lambda first: F.filter("met", lambda g: (g["i"] < groups) if first else (g["i"] >= groups))
    tables = (
        met.join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")
        .select("rep", "n", F.explode(side(True)).alias("g"), side(False).alias("others"))
        .select("rep", "n", "g", F.explode("others").alias("o"))
        .select(F.xxhash64("g.i", "o.i", "g.x", "o.x").alias("key"), F.xxhash64("g.i", "g.x").alias("half"), "rep", "n")
    )
    tables = written(tables, "tables")
    pivots = tables.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot <> last")
    fits = lambda a, b: (100 * F.least(a, b)) >= (percent * F.greatest(a, b))  # noqa: E731  sizes further apart cannot reach the limit
    buckets = written(tables.join(pivots.drop("last"), "key").groupBy("pivot", "rep", "n").agg(F.collect_set("half").alias("halves")), "buckets")
    forget(tables)
    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("pivot_n"))
    star = buckets.where("rep <> pivot").select("pivot", "rep", "n").join(sizes, "pivot").where(fits(F.col("n"), F.col("pivot_n")))
    tried = written(star.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "star")
    links = written(verified(tried, docs, id_col, text_col, size, percent), "links")
    of = components(links)

    # Groups in which a pivot and a member are not connected: all their members.
    label = lambda c: of.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp"))
    stray = buckets.where("rep <> pivot").join(label("rep"), "rep", "left").join(label("pivot"), "pivot", "left")
    stray = stray.where(F.coalesce("rep_comp", "rep") != F.coalesce("pivot_comp", "pivot")).select(F.explode("halves").alias("half")).distinct()
    open_rows = written(buckets.select("rep", "n", F.explode("halves").alias("half")).distinct().join(stray, "half"), "open")
    forget(buckets)

    def placed():
        grouped = open_rows.groupBy("rep", "n").agg(F.collect_list("half").alias("halves"))  # the first collection's groups at most
        return grouped.join(label("rep"), "rep", "left").select(F.explode("halves").alias("half"), "rep", "n", F.coalesce("rep_comp", "rep").alias("comp"))

    def still_open(rows, *more):
        return rows.groupBy("half").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("c"), *more).where("c0 <> c1").drop("c0", "c1")

    made = [links]
    for turn in range(ROUNDS):
        rows = written(placed(), "placed")
        heads = still_open(rows, F.min_by(F.struct(F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("comp").alias("pivot_comp")), F.xxhash64("rep", F.lit(turn))).alias("p"))
        again = rows.join(heads.select("half", "p.*"), "half")
        narrowed = written(again.select("half", "rep", "n"), "open")
        pairs = again.where((F.col("comp") != F.col("pivot_comp")) & fits(F.col("n"), F.col("pivot_n"))).select(F.greatest("pivot", "rep").alias("b"), F.least("pivot", "rep").alias("a"))
        pairs = written(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "star")
        found = written(verified(pairs, docs, id_col, text_col, size, percent), "links")
        forget(rows)
        forget(open_rows)
        open_rows, made = narrowed, [*made, found]
        both = written(tried.union(pairs), "tried")
        forget(tried)
        forget(pairs)
        tried = both
        if found.limit(1).count():
            before = of
            of = components(_all(made))
            forget(before)

    # Pairs that cross components inside a group and were not compared yet.
    rows = written(placed(), "placed")
    mixed = still_open(rows).where("c > 2").select("half", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    left_over = written(rows.join(mixed, "half"), "rest")
    bits = sketches(docs, bloom(left_over, "rep"), id_col, text_col, size).groupBy("id").agg(F.first("sketch").alias("sketch"))
    spread_ = (
        left_over.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(bits.withColumnRenamed("id", "rep"), "rep")
        .select(F.col("half").alias("key"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "n", "comp", "sketch")
    )
    rest = written(block_pairs(spread_, percent).join(tried, ["a", "b"], "left_anti"), "rest")
    more = written(verified(rest, docs, id_col, text_col, size, percent), "links")
    if more.limit(1).count():
        before, of = of, components(_all([*made, more]))
        forget(before)
    for t in (rows, left_over, open_rows, tried, rest, more, *made):
        forget(t)

    members = known.join(classes.drop("groups"), ["n_shingles", "fp1", "fp2"], "left").select("id", "rep")
    chosen = members.join(of.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep", "id").alias("component_id"))
    chosen = chosen.groupBy("id").agg(F.min("component_id").alias("component_id"))
    return sigs.select("id", "n_shingles").join(chosen, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, unchanged, whose id stands for its group; rows with a null id stay."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, id_col, text_col, **kw).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(small(gone), F.col(id_col) == F.col(name), "left_anti")
