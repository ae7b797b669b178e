"""Traffic and alert reports over the stored flow, alert and fingerprint tables.

Every report reduces on the map side before its shuffle; top-k reports keep k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.fixed_values import BENIGN
from tidewatch.operators.filters import of_severity
from tidewatch.operators.sampling import first_per_uid


def traffic_totals(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count(F.lit(1)).alias("flows_total"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in_total"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out_total"),
        F.count_if(~F.col("is_malicious")).alias("benign_count"),
        F.count_if(F.col("is_malicious")).alias("malicious_count"),
    )


def alerts_total(alerts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    counted = (F.col("attack_type") != BENIGN) & (F.col("risk_score") >= settings.counted_alert_floor)
    return alerts.agg(F.count_if(counted).alias("alerts_total"))


def protocol_breakdown(flows: DataFrame) -> DataFrame:
    return flows.groupBy("proto").agg(F.count(F.lit(1)).alias("flows"))


def flow_rate(flows: DataFrame, seconds: int = 1) -> DataFrame:
    """Flows per window and the whole-number rate per second."""
    slot = F.floor(F.col("timestamp") / seconds) * seconds
    return (
        flows.filter(F.col("timestamp").isNotNull())
        .groupBy(slot.alias("window_start"))
        .agg(F.count(F.lit(1)).alias("flows"))
        .withColumn("flows_per_sec", F.floor(F.col("flows") / seconds))
    )


def rate_history(flows: DataFrame, seconds: int = 1, samples: int = 60) -> DataFrame:
    """The newest ``samples`` windows, empty ones as 0. The axis is built from the newest event."""
    newest = flows.agg((F.floor(F.max("timestamp") / seconds) * seconds).alias("newest"))
    shown = newest.select((F.col("newest") - F.lit((samples - 1) * seconds)).alias("since"))
    # only what the windows show is grouped; the newest instant is one row
    rates = flow_rate(flows.join(F.broadcast(shown), F.col("timestamp") >= F.col("since")).drop("since"), seconds)
    axis = newest.select(
        F.explode(
            F.sequence(F.col("newest") - F.lit((samples - 1) * seconds), F.col("newest"), F.lit(seconds).cast("bigint"))
        ).alias("window_start")
    )
    filled = axis.join(rates, "window_start", "left")
    return filled.select("window_start", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("flows", "flows_per_sec")])


def source_activity(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per source and flow window: flows, bytes, distinct destinations and destination ports.

    The measures are this library's choice; only the window length is given.
    The first step removes repeats per (source, window, destination) on the map side, so that a
    source with most of the traffic reaches the second step as its distinct destinations only.
    """
    seconds = settings.flow_window_seconds
    keyed = flows.select(
        "src_ip", "dst_ip", "dst_port",
        F.coalesce(F.col("bytes_in"), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.col("bytes_out"), F.lit(0)).alias("bytes_out"),
        (F.floor(F.col("timestamp") / seconds) * seconds).alias("window_start"),
    )
    return keyed.groupBy("src_ip", "window_start").agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"),
        F.countDistinct("dst_ip").alias("distinct_destinations"),
        F.countDistinct("dst_port").alias("distinct_ports"),
    )


def fingerprint_frequency(flows: DataFrame) -> DataFrame:
    return flows.groupBy("ja3").agg(F.count(F.lit(1)).alias("hits"))


def fingerprint_stats(flows: DataFrame, threats: DataFrame) -> DataFrame:
    """Distinct fingerprints, flows fingerprinted, and distinct fingerprints known as threats."""
    known = threats.select("ja3", F.lit(1).alias("_known"))
    return (
        fingerprint_frequency(flows)
        .join(known, "ja3", "left")
        .agg(
            F.count(F.lit(1)).alias("unique_ja3_count"),
            F.coalesce(F.sum("hits"), F.lit(0)).alias("total_fingerprinted"),
            F.count("_known").alias("threats_detected"),
        )
    )


def fingerprint_stats_approximate(flows: DataFrame) -> DataFrame:
    """Sketch form of the distinct count, for dashboards over very many fingerprints."""
    return flows.agg(
        F.approx_count_distinct("ja3", 0.01).alias("unique_ja3_count"), F.count(F.lit(1)).alias("total_fingerprinted")
    )


def top_fingerprints(flows: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent fingerprints; equal counts in order of first sighting."""
    counts = flows.groupBy("ja3").agg(
        F.count(F.lit(1)).alias("hits"), F.min(F.struct("ts", "uid")).alias("_first")
    )
    return counts.orderBy(F.desc("hits"), "_first", "ja3").limit(n).select("ja3", "hits")


def attack_share(alerts: DataFrame, n: int = 6) -> DataFrame:
    """Top attack types among distinct non-benign alerts, with their share of the top-n sum."""
    counted = first_per_uid(alerts.filter(F.col("attack_type") != BENIGN), ["timestamp"])
    top = (
        counted.groupBy("attack_type")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc("alerts"), "attack_type")
        .limit(n)
    )
    # at most n rows are left, so collecting them in one array and back is free of scale
    gathered = top.agg(F.collect_list(F.struct("attack_type", "alerts")).alias("_top"), F.sum("alerts").alias("_sum"))
    return gathered.select(F.explode("_top").alias("_t"), "_sum").select(
        F.col("_t.attack_type").alias("attack_type"),
        F.col("_t.alerts").alias("alerts"),
        F.round(F.col("_t.alerts") * 100 / F.greatest(F.col("_sum"), F.lit(1))).cast("int").alias("share_pct"),
    )


def recent_alerts(alerts: DataFrame, limit: int | None = None, severity: str = "", settings: Settings = DEFAULTS) -> DataFrame:
    """Newest alerts of the feed. Severity picks from the feed, it does not reach behind it."""
    feed = alerts.orderBy(F.desc("timestamp"), "uid").limit(settings.alert_feed)
    page = of_severity(feed, severity)
    return page.orderBy(F.desc("timestamp"), "uid").limit(settings.alert_page if limit is None else limit)


def recent_flows(flows: DataFrame, limit: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Newest flows, at most the feed length."""
    n = min(settings.flow_page if limit is None else limit, settings.flow_feed)
    return flows.orderBy(F.desc("timestamp"), "uid").limit(n)
