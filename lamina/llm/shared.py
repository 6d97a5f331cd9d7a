"""Scratch tables in the session's shared folder, fixed-size id filters and connected components."""

from __future__ import annotations

import ctypes
import math
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOOM_BITS = 1 << 23, 1 << 28  # least and greatest size of an id filter: 1 MB to 32 MB
BATCH_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode the warehouse serves where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return where.rstrip("/")


# ---- Arrow tasks --------------------------------------------------------------------------------


def _release() -> None:
    """Give freed memory back to the system: workers are kept for later stages, with all that they hold."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _bounded(batches, limit: int):
    """The batches, cut to about ``limit`` bytes; a larger row stands alone."""
    for batch in batches:
        parts = min(batch.num_rows, -(-batch.nbytes // limit))
        step = -(-batch.num_rows // parts) if parts > 1 else max(1, batch.num_rows)
        for lo in range(0, max(1, batch.num_rows), step):
            yield batch.slice(lo, step) if step < batch.num_rows else batch


def in_arrow(df: DataFrame, run, schema, limit: int = BATCH_BYTES) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, and a worker that keeps no memory after a task."""

    def task(batches):
        try:
            yield from run(_bounded(batches, limit))
        finally:
            _release()

    return df.mapInArrow(task, schema)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/lamina/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lamina_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_lamina_path", None)
    if path is not None:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, behind a count of the (short) rows; a larger table is joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until df has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def empty_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what runs inside: for rows of long arrays, which Spark gathers by number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# ---- id filter of fixed size ------------------------------------------------------------------


def _bits(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        y = x * np.uint64(0xC2B2AE3D27D4EB4F)
        y ^= y >> np.uint64(29)
    return (x % np.uint64(bits)).astype(np.int64), (y % np.uint64(bits)).astype(np.int64)


def bloom(ids: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A Bloom filter over a long column, of some 16 bits an id between the bounds in BLOOM_BITS.

    Beyond 16 million ids it fills up and lets more rows through to the exact join that follows.
    Built as a distributed bit_or, so at most bits / 32 words reach the driver.
    """
    if bits is None:
        least, most = BLOOM_BITS
        bits = min(most, max(least, 1 << math.ceil(math.log2(16 * ids.count() + 1))))

    def positions(batches):
        import pyarrow as pa

        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            p = np.unique(np.concatenate(_bits(v, bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p >> 5), pa.array(np.left_shift(np.int64(1), p & 31))], ["word", "bit"]
            )

    words = (
        in_arrow(ids.select(F.col(column).cast("long")), positions, "word long, bit long")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    table = np.zeros(bits >> 5, dtype=np.uint32)
    table[words.column("word").to_numpy()] = words.column("bit").to_numpy().astype(np.uint32)
    return table


def in_bloom(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x, y = _bits(ids, len(table) << 5)

    def hit(p):
        return (table[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1

    return hit(x) & hit(y)


# ---- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id of an undirected edge list.

    Every round takes the least label among the neighbours (partial sums before the shuffle, so a
    hub costs one row per task) and then follows the label one step (pointer jumping). The number
    of rounds is logarithmic in practice; each round's labels are a written table.
    """
    both = written(
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("src is not null and dst is not null and src <> dst")
        .distinct(),
        "edges",
    )
    labels = written(
        both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("component")), "labels"
    )
    while True:
        heard = (
            both.join(labels, both.dst == labels.id)
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("component").alias("heard"))
        )
        near = labels.join(heard, "id").select("id", "component", F.least("component", "heard").alias("now"))
        head = labels.select(F.col("id").alias("now"), F.col("component").alias("then"))
        after = written(
            near.join(head, "now").select(
                "id", F.least("now", "then").alias("component"), (F.least("now", "then") != F.col("component")).alias("moved")
            ),
            "labels",
        )
        moved = after.where("moved").limit(1).count()
        forget(labels)
        labels = after.select("id", "component")
        labels._lamina_path = after._lamina_path
        if not moved:
            forget(both)
            return labels
