"""Corpus preparation: five operators, one after another, over ``documents``.

Each stage gets what its predecessor kept and returns the kept documents with
their columns; the last returns the packed pieces of the documents that are
left. Every stage is written to the shared folder before the next one reads
it, so a lost executor repeats tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm.common import documents, written
from tollgate.llm.exact_dedup import keep_first
from tollgate.llm.language import keep_identified, learn_from_documents
from tollgate.llm.packing import packing_query
from tollgate.llm.quality import keep_good, learn_from_labels
from tollgate.llm.simhash import keep_one
from tollgate.sources.tables import table_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(table_path(sf_dir, "labels"))
    return keep_good(docs, learn_from_labels(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_identified(docs, learn_from_documents(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near-duplicates."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents left."""
    return packing_query(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", packing),
]

#: SQL expresses neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
