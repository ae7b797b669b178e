"""Batch replay: logs in, scored flows, alerts and traffic rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions.flow_features import with_features
from tidewatch.operators.correlate import join_conn_ssl
from tidewatch.operators.filters import alerts_only, drop_noise, with_uid
from tidewatch.operators.risk import alert_records, flow_records, with_risk
from tidewatch.operators.tls_analysis import analyse_tls


def score_flows(
    flows: DataFrame, threats: DataFrame, settings: Settings = DEFAULTS, known: DataFrame | None = None
) -> DataFrame:
    """TLS analysis and risk of correlated flows, with whatever detector scores they carry."""
    return with_risk(analyse_tls(flows, threats, settings, known), settings)


def replay(
    conn: DataFrame,
    ssl: DataFrame,
    threats: DataFrame,
    detectors=None,
    settings: Settings = DEFAULTS,
    min_packets: int = 0,
) -> DataFrame:
    """Score completed logs. ``detectors`` (a ``DetectorSet``) adds its columns; without it every
    detector counts as untrained."""
    flows = join_conn_ssl(drop_noise(with_uid(conn), min_packets), with_uid(ssl))
    if detectors is not None:
        flows = detectors.transform(with_features(flows))
    return score_flows(flows, threats, settings)


def replay_alerts(scored: DataFrame, settings: Settings = DEFAULTS, top_features=None) -> DataFrame:
    return alerts_only(alert_records(scored, top_features, settings), settings)


def replay_traffic(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return flow_records(scored, settings)
