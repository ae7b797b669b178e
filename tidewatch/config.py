"""Tunable settings, passed to operators explicitly (no module state).

Fixed values: the defaults are those that results must agree with.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # correlation
    uid_ttl_seconds: int = 120
    coalesce_seconds: int = 2
    early_lateness_seconds: int = 2
    live_min_packets: int = 3
    flow_window_seconds: int = 30

    # risk fusion
    alert_threshold: int = 65
    block_threshold: int = 75
    counted_alert_floor: int = 20
    critical_floor: int = 85
    high_floor: int = 70
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "isolation_forest": 0.05,
            "random_forest": 0.55,
            "transformer": 0.35,
            "statistical": 0.05,
        }
    )
    unfitted: dict[str, float] = field(
        default_factory=lambda: {
            "isolation_forest": 0.5,
            "random_forest": 0.5,
            "transformer": 0.5,
            "statistical": 0.0,
        }
    )
    tls_boost_points: int = 30
    flag_443_without_tls: bool = False

    # response
    block_seconds: int = 1800

    # feeds
    alert_feed: int = 200
    alert_page: int = 50
    flow_feed: int = 500
    flow_page: int = 100

    # detectors
    iso_trees: int = 100
    iso_sample: int = 256
    iso_contamination: float = 0.01
    rf_trees: int = 200
    rf_depth: int = 20
    seed: int = 42
    sequence_length: int = 10
    sequence_threshold: float = 0.05
    ewma_alpha: float = 0.05
    ewma_z: float = 3.5
    ewma_warmup: int = 30

    # training: the anomaly detectors see all benign rows, the classifier all rows
    test_fraction: float = 0.2
    sequence_validation_fraction: float = 0.1


DEFAULTS = Settings()
