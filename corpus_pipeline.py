"""A training corpus from raw documents: language, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import small_batches, stored_table
from tidewatch.llm.language import identified
from tidewatch.llm.mixing import mixed
from tidewatch.llm.neardup import one_of_each
from tidewatch.llm.packing import pack
from tidewatch.llm.queries import tokenizer

ORACLE_SQL = None  # trained models, minimum hashes and token ids have no SQL; tests hold the stages against brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a learned language stay, and get that language."""
    small_batches(spark)
    return identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    small_batches(spark)
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are repeated, cut or left out, and stand in training order."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 4096. Workers serve other stages too, so they remember fewer words."""
    small_batches(spark)
    return pack(docs, tokenizer(), held_words=60_000)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored_table(stage(spark, docs, sf_dir), name)
    return docs
