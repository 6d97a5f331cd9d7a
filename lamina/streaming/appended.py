"""A surface store that grows by micro-batches: new mesh points near known ones are left out.

The counterpart of an append-only chunk log with several writers: each batch is compared with the
store by a cell join, and appended as new files, under its batch number so that a batch
that runs twice is written once. Near points of one batch are all kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.spatial import erase_near


def append_surface(stream: DataFrame, store: str, checkpoint: str, radius: float = 2.0) -> StreamingQuery:
    """Starts a query that appends the stream's points (pid, qx, qy, vx, vy, vz) unless the store has a point within ``radius``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store).where(F.col("batch") != number)
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = batch if known is None else erase_near(batch, known, "vx vy vz", radius)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_scores(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Best score and samples per run and time window of a stream (ts, file, score), with late rows up to ``late``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "file").agg(F.max("score").alias("best"), F.count("*").alias("n"))
