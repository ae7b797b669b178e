"""The 39-column flow feature vector as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fixed_values import FEATURE_NAMES, PROTOCOL_NUMBERS, SERVICE_IDS
from tidewatch.functions.history import retransmissions, tcp_flags
from tidewatch.functions.numeric import field, finite, finite_field, nonzero_or


def code_of(text: Column, codes: dict[str, float], default: float = 0.0) -> Column:
    """Case-insensitive lookup in a short fixed code table."""
    entries: list[Column] = []
    for name, code in codes.items():
        entries += [F.lit(name), F.lit(code)]
    return F.coalesce(F.create_map(*entries)[F.lower(text)], F.lit(default))


def in_bytes(df: DataFrame) -> Column:
    return nonzero_or(field(df, "orig_ip_bytes", "bigint"), field(df, "orig_bytes", "bigint"))


def out_bytes(df: DataFrame) -> Column:
    return nonzero_or(field(df, "resp_ip_bytes", "bigint"), field(df, "resp_bytes", "bigint"))


def with_features(df: DataFrame) -> DataFrame:
    """Append the features to every flow. Row-local: no shuffle, no Python, one codegen stage."""
    history = field(df, "history", "string")
    base = df.withColumns(
        {
            "_ib": finite_field(df, "orig_ip_bytes", "orig_bytes"),
            "_ip": finite_field(df, "orig_pkts"),
            "_ob": finite_field(df, "resp_ip_bytes", "resp_bytes"),
            "_op": finite_field(df, "resp_pkts"),
            "_d": finite(field(df, "duration", "double")),
            "_client": tcp_flags(history, "client"),
            "_server": tcp_flags(history, "server"),
            "_rt": retransmissions(history).cast("double"),
        }
    ).withColumns(
        {
            "_ai": F.when(F.col("_ip") > 0, F.col("_ib") / F.col("_ip")).otherwise(0.0),
            "_ao": F.when(F.col("_op") > 0, F.col("_ob") / F.col("_op")).otherwise(0.0),
            "_sd": F.greatest(F.col("_d"), F.lit(0.001)),
        }
    )
    ib, ip, ob, op = F.col("_ib"), F.col("_ip"), F.col("_ob"), F.col("_op")
    d, ai, sd = F.col("_d"), F.col("_ai"), F.col("_sd")
    sent = ip > 0
    longest = F.greatest(ai, F.col("_ao")) * 1.5
    packets = ip + op

    def when_sent(value: float) -> Column:
        return F.when(sent, value).otherwise(0.0)

    def size_bin(low: int | None, high: int | None) -> Column:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (ai >= low)
        if high is not None:
            inside = inside & (ai < high)
        return F.when(inside, packets).otherwise(0.0)

    values = {name: F.lit(0.0) for name in FEATURE_NAMES}
    values.update(
        {
            "PROTOCOL": code_of(field(df, "proto", "string"), PROTOCOL_NUMBERS),
            "L7_PROTO": code_of(field(df, "service", "string"), SERVICE_IDS),
            "IN_BYTES": ib,
            "IN_PKTS": ip,
            "OUT_BYTES": ob,
            "OUT_PKTS": op,
            "TCP_FLAGS": F.col("_client").bitwiseOR(F.col("_server")),
            "CLIENT_TCP_FLAGS": F.col("_client"),
            "SERVER_TCP_FLAGS": F.col("_server"),
            "FLOW_DURATION_MILLISECONDS": d * 1000,
            "DURATION_IN": F.when(sent, d * 1000 / 2).otherwise(0.0),
            "DURATION_OUT": F.when(op > 0, d * 1000 / 2).otherwise(0.0),
            "MIN_TTL": when_sent(64.0),
            "MAX_TTL": when_sent(64.0),
            "LONGEST_FLOW_PKT": longest,
            "SHORTEST_FLOW_PKT": when_sent(40.0),
            "MIN_IP_PKT_LEN": when_sent(40.0),
            "MAX_IP_PKT_LEN": longest,
            "SRC_TO_DST_SECOND_BYTES": ib / sd,
            "DST_TO_SRC_SECOND_BYTES": ob / sd,
            "RETRANSMITTED_IN_PKTS": F.col("_rt"),
            "RETRANSMITTED_OUT_PKTS": F.col("_rt"),
            "SRC_TO_DST_AVG_THROUGHPUT": ib * 8 / sd,
            "DST_TO_SRC_AVG_THROUGHPUT": ob * 8 / sd,
            "NUM_PKTS_UP_TO_128_BYTES": size_bin(None, 128),
            "NUM_PKTS_128_TO_256_BYTES": size_bin(128, 256),
            "NUM_PKTS_256_TO_512_BYTES": size_bin(256, 512),
            "NUM_PKTS_512_TO_1024_BYTES": size_bin(512, 1024),
            "NUM_PKTS_1024_TO_1514_BYTES": size_bin(1024, None),
        }
    )
    kept = [c for c in df.columns if c not in FEATURE_NAMES]
    return base.select(*kept, *[values[n].cast("double").alias(n) for n in FEATURE_NAMES])
