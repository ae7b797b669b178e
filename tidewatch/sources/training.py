"""Labelled training flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.schemas import TRAINING_SCHEMA


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """NetFlow CSV with a header. The schema is given, so the file is read once and columns that
    are not used are never parsed; ``enforceSchema=False`` checks the header names against it."""
    return spark.read.csv(path, header=True, schema=TRAINING_SCHEMA, enforceSchema=False)
