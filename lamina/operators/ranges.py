"""Ranks and running sums over all rows of a table, without a task that sees them all.

Rows go to ranges of their order, as many as there are shuffle partitions; the ranges' own totals, one row each, give
where each begins. So the single window has a fixed number of rows, however the table grows or its ids lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.scratch import saved


def running_sum(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one by ``order``, which should be unique. Null values add nothing; an empty table stays empty."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(df.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy("_part").agg(F.sum("_v").alias("_t"))
    base = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_base"))
    inside = F.sum("_v").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + inside).drop("_part", "_base", "_v")


def ranked(df: DataFrame, order: str) -> DataFrame:
    """Adds ``rank``, from 1, over all rows."""
    return running_sum(df, order, F.lit(1).cast("long"), "rank")
