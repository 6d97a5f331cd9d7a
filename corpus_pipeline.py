"""A corpus pipeline of five stages over the documents table. Counted as part of lamina.llm.

Stages take documents with columns of any name beside doc_id, text and n_chars, and an empty table gives an empty one. A null text
counts as empty. Rows that share a doc_id (repeated rows too) share its fate in the stages that tell documents by their id, that is all but the
first and the last; rows with a null doc_id pass those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.decontamination import clean_documents
from lamina.llm.minhash import one_of_each
from lamina.llm.quality_rules import kept_documents
from lamina.llm.sentencepiece_scan import round_trip
from lamina.llm.shared import written
from lamina.llm.substring import without_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and too short texts too. Equal rows have equal fates."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id; a document without words is linked with nothing and stays, as do rows with a null doc_id."""
    return one_of_each(docs, percent=85)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; n_chars follows the text. Documents that have no word left go; rows with a null doc_id stay."""
    return without_passages(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; an empty benchmark takes none, and rows with a null doc_id stay."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to; a null or empty text has none."""
    return round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


ORACLE_SQL = None
