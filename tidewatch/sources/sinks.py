"""Alert and flow outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; missing fields are written as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    as_json(df).write.mode(mode).text(path)


def write_by_day(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by event day, so that feeds and KPIs read only the days they ask for.

    Rows keep the partitioning they come with: gathering each day in one task first would put a
    whole day's traffic there. AQE's rebalance splits large days and merges small ones instead.
    """
    day = F.to_date(F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint")))
    (
        df.withColumn("day", day)
        .hint("rebalance", "day")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )
