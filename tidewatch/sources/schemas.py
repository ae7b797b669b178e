"""Explicit schemas of the inputs; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from tidewatch.functions.fixed_values import FEATURE_NAMES

# Field -> type of each sensor log, in the order the sensor writes by default.
# Dots of the log's names are underscores here, so that no column needs quoting.
LOG_FIELDS: dict[str, dict[str, str]] = {
    "conn": {
        "uid": "string", "ts": "timestamp",
        "id_orig_h": "string", "id_orig_p": "int", "id_resp_h": "string", "id_resp_p": "int",
        "proto": "string", "service": "string", "duration": "double",
        "orig_bytes": "bigint", "resp_bytes": "bigint", "orig_pkts": "bigint", "resp_pkts": "bigint",
        "orig_ip_bytes": "bigint", "resp_ip_bytes": "bigint",
        "conn_state": "string", "history": "string", "missed_bytes": "bigint",
    },
    "ssl": {
        "uid": "string", "ts": "timestamp", "version": "string", "cipher": "string", "curve": "string",
        "server_name": "string", "ja3": "string", "ja3s": "string",
        "resumed": "boolean", "established": "boolean", "cert_chain_fuids": "array<string>",
    },
    "dns": {
        "uid": "string", "ts": "timestamp", "query": "string", "qtype_name": "string",
        "rcode_name": "string", "answers": "array<string>", "TTLs": "array<double>",
    },
    "weird": {
        "uid": "string", "ts": "timestamp", "name": "string", "addl": "string", "notice": "boolean",
    },
}

FEED_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("ja3_md5", "first_seen", "last_seen", "reason")]
)

TRAINING_SCHEMA = T.StructType(
    [
        T.StructField("IPV4_SRC_ADDR", T.StringType()),
        T.StructField("L4_SRC_PORT", T.IntegerType()),
        T.StructField("IPV4_DST_ADDR", T.StringType()),
        T.StructField("L4_DST_PORT", T.IntegerType()),
        *[T.StructField(n, T.DoubleType()) for n in FEATURE_NAMES],
        T.StructField("Label", T.IntegerType()),
        T.StructField("Attack", T.StringType()),
        T.StructField("Dataset", T.StringType()),
    ]
)


def log_schema(log: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in LOG_FIELDS[log].items()))
