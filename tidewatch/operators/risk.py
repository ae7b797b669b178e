"""Fusion of detector scores, attack type, alerts and flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions import wording
from tidewatch.functions.fixed_values import ATTACK_LABELS, BENIGN, UNKNOWN_ALTERNATIVE, UNKNOWN_LABEL
from tidewatch.functions.flow_features import in_bytes, out_bytes
from tidewatch.functions.numeric import (
    epoch_seconds,
    field,
    finite,
    nonzero_or,
    present,
    round3,
    truncated_score,
)
from tidewatch.operators.intel import in_blocklist

# Detector name in the alert -> score column.
SCORE_COLUMNS = {
    "isolation_forest": "isolation_forest_score",
    "random_forest": "random_forest_score",
    "transformer": "sequence_score",
    "statistical": "statistical_score",
}


def label_of(class_id: Column, labels: dict[int, str] | None = None, default: str = UNKNOWN_LABEL) -> Column:
    """Class id to label through a map of at most some dozens of classes."""
    table = labels or ATTACK_LABELS
    entries: list[Column] = []
    for k, v in table.items():
        entries += [F.lit(int(k)), F.lit(v)]
    return F.coalesce(F.create_map(*entries)[class_id.cast("int")], F.lit(default))


def detector_scores(df: DataFrame, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Score of each detector; one that has not been run counts with its untrained value."""
    return {
        name: F.coalesce(field(df, column, "double"), F.lit(settings.unfitted[name]))
        for name, column in SCORE_COLUMNS.items()
    }


def fused_score(scores: dict[str, Column], settings: Settings = DEFAULTS) -> Column:
    total = None
    for name, score in scores.items():
        part = F.lit(settings.weights.get(name, 0.0)) * score
        total = part if total is None else total + part
    return total


def with_risk(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add risk_score 0..100, ja3_blocked, severity, attack_type and should_block.

    Needs the TLS columns; detector scores, attack_label and alternative_label are optional.
    """
    base = truncated_score(fused_score(detector_scores(flows, settings), settings))
    boost = F.when(F.col("tls_risk") > 0, (F.col("tls_risk") * settings.tls_boost_points).cast("int")).otherwise(0)
    legacy = present(field(flows, "JA3_HASH", "string"))
    blocked = F.col("tls_malicious") | in_blocklist(legacy)
    label = F.coalesce(field(flows, "attack_label", "string"), F.lit(BENIGN))
    other = F.coalesce(field(flows, "alternative_label", "string"), F.lit(BENIGN))
    return (
        flows.withColumn("ja3_blocked", blocked)
        .withColumn("base_score", base)
        .withColumn("risk_score", F.when(blocked, 100).otherwise(F.least(F.lit(100), F.col("base_score") + boost)))
        .withColumns(
            {
                "severity": wording.severity(F.col("risk_score"), settings),
                "attack_type": F.when(
                    (label == BENIGN) & (F.col("risk_score") >= settings.alert_threshold), other
                ).otherwise(label),
                "should_block": F.col("risk_score") >= settings.block_threshold,
            }
        )
    )


def identities(df: DataFrame) -> dict[str, Column]:
    """Who talked to whom: NetFlow names first, connection-log names otherwise."""

    def text(a: str, b: str, default: str) -> Column:
        return F.coalesce(present(field(df, a, "string")), field(df, b, "string"), F.lit(default))

    def port(a: str, b: str) -> Column:
        return F.coalesce(nonzero_or(field(df, a, "int"), field(df, b, "int")), F.lit(0))

    # PROTOCOL names the identity only in NetFlow input; elsewhere it is the model feature
    protocol = present(field(df, "proto", "string"))
    if "IPV4_SRC_ADDR" in df.columns and "PROTOCOL" in df.columns:
        number = F.col("PROTOCOL").try_cast("bigint")
        protocol = F.coalesce(F.when(number != 0, number.cast("string")), protocol)
    return {
        "src_ip": text("IPV4_SRC_ADDR", "id_orig_h", "Unknown"),
        "dst_ip": text("IPV4_DST_ADDR", "id_resp_h", "Unknown"),
        "src_port": port("L4_SRC_PORT", "id_orig_p"),
        "dst_port": port("L4_DST_PORT", "id_resp_p"),
        "protocol": F.coalesce(protocol, F.lit("")),
    }


def alert_records(
    scored: DataFrame, top_features: list[tuple[str, float]] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """The alert form of every scored flow (apply ``alerts_only`` for those that fire)."""
    who = identities(scored)
    scores = detector_scores(scored, settings)
    named_scores: list[Column] = []
    for name, value in scores.items():
        named_scores += [F.lit(name), round3(value)]
    features = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance")) for n, v in top_features or []]
    ).cast("array<struct<feature:string,importance:double>>")
    return scored.select(
        "uid",
        epoch_seconds(F.col("ts")).alias("timestamp"),
        wording.endpoint(who["src_ip"], who["src_port"]).alias("src"),
        wording.endpoint(who["dst_ip"], who["dst_port"]).alias("dst"),
        who["protocol"].alias("proto"),
        "risk_score",
        "severity",
        "attack_type",
        "should_block",
        F.create_map(*named_scores).alias("detector_scores"),
        features.alias("top_features"),
        wording.explanation(
            who["src_ip"], who["dst_ip"], F.col("risk_score"), F.col("ja3_blocked"),
            F.col("tls_threat"), F.col("tls_risk_factors"),
        ).alias("explanation"),
        "ja3",
        "ja3s",
        "ja3_blocked",
        "tls_version",
        round3(F.col("tls_risk")).alias("tls_risk_score"),
        "tls_risk_factors",
        "tls_threat",
    )


def flow_records(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The traffic row of every scored flow."""
    who = identities(scored)

    def count(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)).cast("bigint")

    return scored.select(
        "uid",
        epoch_seconds(F.col("ts")).alias("timestamp"),
        wording.endpoint(who["src_ip"], who["src_port"]).alias("src"),
        wording.endpoint(who["dst_ip"], who["dst_port"]).alias("dst"),
        who["protocol"].alias("proto"),
        count(in_bytes(scored)).alias("bytes_in"),
        count(out_bytes(scored)).alias("bytes_out"),
        count(field(scored, "orig_pkts", "bigint")).alias("packets_in"),
        count(field(scored, "resp_pkts", "bigint")).alias("packets_out"),
        F.bround(finite(field(scored, "duration", "double")) * 1000, 1).alias("duration_ms"),
        "attack_type",
        "risk_score",
        "severity",
        ((F.col("attack_type") != BENIGN) & (F.col("risk_score") >= settings.alert_threshold)).alias("is_malicious"),
    )
