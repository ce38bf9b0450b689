"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame,
and their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table_path
from .alignment import alignment_query
from .ann import ann_query
from .byte_bpe import digests
from .common import documents
from .conversation_trie import TRIE_SQL, conversation_trie_query
from .counts import token_counts
from .exact_dedup import EXACT_DEDUP_SQL, exact_dedup_query
from .histogram_packing import histogram_packing_query
from .language import language_query
from .packing import packing_query
from .quality import quality_query
from .sharding import sharding_query
from .simhash import simhash_query
from .url_filter import URL_SQL, url_query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_query(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_query(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_query(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_query(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_query(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_query(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_query(documents(spark, sf_dir))


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing_query(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie_query(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_ann, op2_simhash, op3_sharding, op4_exact_dedup, op5_language_id, op6_token_counts, op7_packing, op8_url_filter, op9_quality,
    op10_byte_bpe, op11_alignment, op12_histogram_packing, op13_conversation_trie)}
ORACLES = {"op4_exact_dedup": EXACT_DEDUP_SQL, "op8_url_filter": URL_SQL, "op13_conversation_trie": TRIE_SQL}
