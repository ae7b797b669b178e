"""TLS analysis of flows: fingerprint, intelligence match, first sighting, risk and its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.functions import tls
from tidewatch.functions.fixed_values import NO_TLS_FINGERPRINT, NO_TLS_THREAT
from tidewatch.functions.numeric import field, present
from tidewatch.operators.intel import lookup_threats


def _first_reported(df: DataFrame, *names: str) -> Column:
    """First non-empty of several spellings of a field; '-' then means missing."""
    value = F.coalesce(*[present(field(df, n, "string")) for n in names])
    return F.when(value != "-", value)


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Add ja3 (raw, else from metadata, else the fixed no-TLS value), ja3s and the TLS fields."""
    parsed = df.withColumns(
        {
            "_raw_ja3": _first_reported(df, "ssl_ja3", "ja3", "JA3_HASH"),
            "_ja3s": _first_reported(df, "ssl_ja3s", "ja3s"),
            "tls_version": _first_reported(df, "ssl_version", "version"),
            "tls_cipher": _first_reported(df, "ssl_cipher", "cipher"),
            "tls_server_name": _first_reported(df, "ssl_server_name", "server_name"),
        }
    )
    derived = tls.metadata_fingerprint(F.col("tls_version"), F.col("tls_cipher"), F.col("tls_server_name"))
    known = F.coalesce(F.col("_raw_ja3"), derived)
    return parsed.withColumns(
        {
            "ja3": F.coalesce(known, F.lit(NO_TLS_FINGERPRINT)),
            "ja3s": F.col("_ja3s"),
            "is_pseudohash": F.col("_raw_ja3").isNull() & derived.isNotNull(),
            "has_tls": known.isNotNull(),
        }
    ).drop("_raw_ja3", "_ja3s")


def _sighting(df: DataFrame) -> Column:
    """What orders sightings: event time, uid, then the TLS fields of repeated uids."""
    extra = [c for c in ("ssl_ts",) if c in df.columns]
    return F.struct(
        "ts", "uid", *extra, "tls_version", "tls_cipher", "tls_server_name", "ja3s",
    )


def _instant() -> Column:
    """Event time as a number; a missing time comes before all others."""
    return F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 63)))


def first_sightings(flows: DataFrame) -> DataFrame:
    """One row per fingerprint: its earliest sighting.

    The earliest instant is a map-side combined minimum of a number, so a fingerprint shared
    by most flows (the no-TLS one) costs one row per task in the shuffle; only the rows of that instant, found by
    fingerprint and instant together, are compared further.
    """
    rows = flows.select("ja3", _instant().alias("_t"), _sighting(flows).alias("_s"))
    earliest = rows.groupBy("ja3").agg(F.min("_t").alias("_t"))
    return rows.join(earliest, ["ja3", "_t"]).groupBy("ja3").agg(F.min("_s").alias("_first"))


def with_first_seen(flows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add ``first_seen``: this row is the first of its fingerprint over all flows.

    ``known`` (column ja3) holds fingerprints of earlier runs, which are no longer new. The marks, one per
    fingerprint, are joined back by uid: uids spread evenly where fingerprints would not, and flows that a join
    by uid made stay where they are. Repeated copies of one and the same record are one sighting and share the flag.
    """
    firsts = first_sightings(flows)
    if known is not None:
        firsts = firsts.join(known.select("ja3").distinct(), "ja3", "left_anti")
    marks = firsts.select(F.col("ja3").alias("_ja3"), F.col("_first.uid").alias("_uid"), "_first")
    # the fingerprint is compared outside the join key, which would deal the flows anew
    same = F.xxhash64("ja3").bitwiseXOR(F.xxhash64("_ja3")) == 0
    marked = flows.withColumn("_sighting", _sighting(flows)).join(marks, (F.col("uid") == F.col("_uid")) & same, "left")
    first = (F.col("_sighting") == F.col("_first")) & (F.col("ja3") == F.col("_ja3"))
    return marked.withColumn("first_seen", F.coalesce(first, F.lit(False))).drop("_sighting", "_first", "_ja3", "_uid")


def with_tls_risk(flows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add the match result, the ordered reasons and the risk 0..1 (the strongest reason)."""
    version, cipher, name = F.col("tls_version"), F.col("tls_cipher"), F.col("tls_server_name")
    client, server = F.col("ja3_malware"), F.col("ja3s_malware")
    version_score = tls.version_score(version)
    weak = tls.weak_cipher(cipher)
    name_risk = F.coalesce(F.col("_name_risk"), F.lit(0.0))
    malicious = client.isNotNull() | server.isNotNull()
    new = F.col("first_seen") & ~malicious
    bare_443 = F.lit(False)
    if settings.flag_443_without_tls:
        port = field(flows, "id_resp_p", "int")
        service = F.coalesce(field(flows, "service", "string"), F.lit(""))
        bare_443 = (port == 443) & ~F.col("has_tls") & (service != "ssl")

    # Wording and weight of each reason, strongest evidence first.
    reasons = [
        (client.isNotNull(), F.concat(F.lit("JA3 matches known malware: "), client), F.lit(1.0)),
        (server.isNotNull(), F.concat(F.lit("JA3S server fingerprint matches: "), server), F.lit(0.95)),
        (version_score > 0.3, F.concat(F.lit("Deprecated TLS version: "), version), version_score * 0.7),
        (
            weak.isNotNull(),
            F.concat(F.lit("Weak cipher detected: "), weak, F.lit(" in "), cipher),
            F.lit(0.5),
        ),
        (name_risk > 0, F.concat(F.lit("Suspicious SNI pattern: "), name), name_risk),
        (bare_443, F.lit("Port 443 without TLS handshake — possible tunneling"), F.lit(0.4)),
        (
            new,
            F.concat(F.lit("First-time JA3 fingerprint observed: "), F.substring("ja3", 1, 12), F.lit("...")),
            F.lit(0.15),
        ),
    ]
    base_name = F.when(~F.col("has_tls"), NO_TLS_THREAT)
    client_name = F.coalesce(client, base_name)
    threat = F.when(
        server.isNotNull(),
        F.concat(F.coalesce(client_name, F.lit("")), F.lit(" + "), server, F.lit(" (server)")),
    ).otherwise(client_name)
    no_text = F.array().cast("array<string>")
    # the entropy is the one expression without generated code: in a column of its own it leaves the
    # rest of the analysis in whole-stage codegen
    return (
        flows.withColumn("_entropy", tls.label_entropy(name))
        .withColumn("_name_risk", tls.server_name_risk(name, F.col("_entropy")))
        .withColumns(
            {
                "tls_malicious": malicious,
                "tls_threat": threat,
                "tls_risk": F.greatest(F.lit(0.0), *[F.when(test, weight).otherwise(0.0) for test, _, weight in reasons]),
                "tls_risk_factors": F.concat(*[F.when(test, F.array(text)).otherwise(no_text) for test, text, _ in reasons]),
            }
        )
        .drop("_name_risk", "_entropy")
    )


def analyse_tls(
    flows: DataFrame,
    threats: DataFrame,
    settings: Settings = DEFAULTS,
    known: DataFrame | None = None,
) -> DataFrame:
    """Fingerprint, look up, mark first sightings and score."""
    looked_up = lookup_threats(with_fingerprint(flows), threats)
    return with_tls_risk(with_first_seen(looked_up, known), settings)
