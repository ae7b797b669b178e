"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings


def with_uid(df: DataFrame) -> DataFrame:
    """Records that can be correlated: uid present."""
    return df.filter(F.col("uid").isNotNull() & (F.col("uid") != ""))


def drop_noise(conn: DataFrame, min_packets: int) -> DataFrame:
    """Connections of at least ``min_packets`` packets; a missing count is 0. Use 0 for replay."""
    if min_packets <= 0:
        return conn
    packets = F.coalesce(F.col("orig_pkts"), F.lit(0)) + F.coalesce(F.col("resp_pkts"), F.lit(0))
    return conn.filter(packets >= min_packets)


def alerts_only(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return scored.filter(F.col("risk_score") >= settings.alert_threshold)


def benign_only(training: DataFrame) -> DataFrame:
    return training.filter(F.col("Label") == 0)


def of_severity(alerts: DataFrame, severity: str = "") -> DataFrame:
    return alerts.filter(F.col("severity") == severity) if severity else alerts
