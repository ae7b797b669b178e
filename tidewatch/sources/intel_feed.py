"""Fingerprint feed and its snapshot."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.schemas import FEED_SCHEMA

# Fixed value: an md5 in hex.
MD5_PATTERN = "^[0-9a-f]{32}$"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed CSV: ``#`` comments and rows of fewer than three fields are dropped, and so is any
    row whose first field is no md5."""
    rows = spark.read.csv(path, schema=FEED_SCHEMA, comment="#")
    return _valid(rows)


def _valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("ja3_md5").rlike(MD5_PATTERN) & F.col("last_seen").isNotNull())


def write_snapshot(feed: DataFrame, path: str) -> None:
    feed.select(*FEED_SCHEMA.fieldNames()).write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, load) -> DataFrame | None:
    try:
        return load()
    except AnalysisException:
        return None


def load_feed(spark: SparkSession, path: str | None, snapshot: str | None) -> DataFrame:
    """The feed when it can be read, else the last good snapshot, else no entries."""
    loaded = _exists(spark, lambda: read_feed(spark, path)) if path else None
    if loaded is None and snapshot:
        loaded = _exists(spark, lambda: spark.read.schema(FEED_SCHEMA).parquet(snapshot))
    return loaded if loaded is not None else spark.createDataFrame([], FEED_SCHEMA)


def refresh_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """Read the feed and keep it as the new snapshot; an unreadable feed leaves the old one."""
    fresh = _exists(spark, lambda: read_feed(spark, path))
    if fresh is not None:
        write_snapshot(fresh, snapshot)
    return load_feed(spark, None, snapshot)
