"""Folders for tables that a job writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode the warehouse serves where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lamina/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table in the session's shared folder.

    Unlike a checkpoint, which keeps the estimates of its plan, it has its true size, so the estimates of
    joins do not multiply from round to round.
    """
    path = new_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
