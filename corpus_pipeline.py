"""The corpus pipeline: raw documents to packed training sequences.

STAGES lists its steps in order. Each takes (spark, docs, sf_dir) and works on all that the step
before it kept; all but the last return the columns of documents. ``run`` applies them to the
documents table, writing each step's rows to the shared staging folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import line_dedup, near_dedup, packing, quality_model, secrets
from wayfare.llm.queries import bound_batches
from wayfare.session import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality model, trained on the labelled ones, rejects."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.train(docs, labels))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that many sources carry out of the texts."""
    return line_dedup.drop_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

# A trained network and masked texts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
