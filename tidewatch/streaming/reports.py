"""Continuous forms of dedup, first sightings and windowed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.streaming.run import ROCKSDB


def dedup_stream(flows: DataFrame, event_time: str = "ts", delay_seconds: int | None = None) -> DataFrame:
    """First arrival per uid; state is dropped once the watermark has passed it."""
    seconds = DEFAULTS.uid_ttl_seconds if delay_seconds is None else delay_seconds
    return flows.withWatermark(event_time, f"{seconds} seconds").dropDuplicatesWithinWatermark(["uid"])


def new_fingerprints(flows: DataFrame) -> DataFrame:
    """First arrival of each fingerprint, for ever: the state holds one row per distinct fingerprint."""
    return flows.dropDuplicates(["ja3"])


def first_sighting_state(flows: DataFrame) -> DataFrame:
    """Update-mode stream: of each fingerprint its earliest row so far (ts, uid) and whether that row was malicious. The state has a row
    per fingerprint, and rows are combined before they reach it, so neither a fingerprint that most flows share nor the
    batches before make a batch dearer. Only fingerprints whose earliest row changed come out."""
    first = F.min(F.struct("ts", "uid", "tls_malicious")).alias("first")
    return flows.filter("ja3 is not null").groupBy("ja3").agg(first)


def first_sightings_known(changes: DataFrame) -> DataFrame:
    """ja3, uid of its first row, malicious, is_new (a first row that is malicious is no news), from all changes so far."""
    first = changes.groupBy("ja3").agg(F.min("first").alias("first"))
    return first.select("ja3", F.col("first.uid").alias("uid"), F.col("first.tls_malicious").alias("malicious"), (~F.col("first.tls_malicious")).alias("is_new"))


def source_activity_stream(flows: DataFrame, settings: Settings = DEFAULTS, delay_seconds: int | None = None) -> DataFrame:
    """Tumbling flow windows per source. A stream cannot count distinct values exactly, so it uses
    a sketch of 0.8 % standard error; the batch report is exact. The sketch holds the few destinations of most windows as a list
    (a fixed table of registers would take 13 KB a window), and state lives in the RocksDB store, not in the executors' heap."""
    flows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seconds = settings.uid_ttl_seconds if delay_seconds is None else delay_seconds
    return (
        flows.withWatermark("ts", f"{seconds} seconds")
        .groupBy(F.window("ts", f"{settings.flow_window_seconds} seconds"), "src_ip")
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum("bytes_in").alias("bytes_in"),
            F.sum("bytes_out").alias("bytes_out"),
            F.hll_sketch_estimate(F.hll_sketch_agg("dst_ip", 14)).alias("distinct_destinations"),
        )
        .select(F.col("window.start").alias("window_start"), "src_ip", "flows", "bytes_in", "bytes_out", "distinct_destinations")
    )


def flow_rate_stream(flows: DataFrame, seconds: int = 1, delay_seconds: int | None = None) -> DataFrame:
    wait = DEFAULTS.uid_ttl_seconds if delay_seconds is None else delay_seconds
    return (
        flows.withWatermark("ts", f"{wait} seconds")
        .groupBy(F.window("ts", f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("flows"))
        .select(F.col("window.start").alias("window_start"), "flows", F.floor(F.col("flows") / seconds).alias("flows_per_sec"))
    )
