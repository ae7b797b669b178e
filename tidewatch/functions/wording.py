"""Severity bands, endpoints and the plain-language explanation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings


def severity(score: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(score >= settings.critical_floor, "critical")
        .when(score >= settings.high_floor, "high")
        .when(score >= settings.alert_threshold, "medium")
        .otherwise("low")
    )


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def explanation(
    src: Column, dst: Column, risk: Column, blocked: Column, threat: Column, factors: Column
) -> Column:
    """One sentence or two on why the flow was flagged; the first rule that applies words it."""
    points = risk.cast("string")
    detail = F.array_join(F.slice(factors, 1, 2), "; ")
    named = threat.isNotNull() & (threat != "")
    high = risk > 85

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    # The message templates.
    return (
        F.when(
            blocked & named,
            say(
                "CRITICAL: Device ", src, " used a TLS fingerprint (JA3) matching known malware '", threat,
                "'. Connection to ", dst, " was flagged for immediate blocking.",
            ),
        )
        .when(
            blocked,
            say(
                "CRITICAL: Device ", src, " used an encrypted connection (JA3) identical to known malware. "
                "Blocked immediately.",
            ),
        )
        .when(
            (F.size(factors) > 0) & high,
            say(
                "High-confidence threat from ", src, " → ", dst, ". TLS analysis: ", detail,
                ". Network behavior strongly indicates an automated attack.",
            ),
        )
        .when(
            F.size(factors) > 0,
            say("Suspicious activity from ", src, " → ", dst, " (Risk: ", points, "). TLS indicators: ", detail, "."),
        )
        .when(
            high,
            say(
                "High-confidence anomaly detected from ", src, " to ", dst,
                ". Traffic volume and timing strongly indicate an automated attack.",
            ),
        )
        .otherwise(
            say("Suspicious network behavior detected from ", src, " to ", dst, " (Risk Score: ", points, ").")
        )
    )
