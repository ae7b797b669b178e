"""Filters, projections, joins, features, TLS and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.registry import query
from tidewatch.catalog.views import view
from tidewatch.functions import tls, wording
from tidewatch.functions.fixed_values import ATTACK_LABELS, FEATURE_NAMES, PROTOCOL_NUMBERS, SERVICE_IDS
from tidewatch.functions.flow_features import code_of
from tidewatch.functions.history import retransmissions, tcp_flags
from tidewatch.functions.numeric import clean_feature, epoch_seconds, finite, truncated_score
from tidewatch.operators import intel, statistics
from tidewatch.operators.correlate import correlate, join_conn_ssl, prefixed
from tidewatch.operators.filters import alerts_only, benign_only, drop_noise, of_severity, with_uid
from tidewatch.operators.risk import alert_records, fused_score, identities, label_of, with_risk
from tidewatch.operators.tls_analysis import with_first_seen

# ---- filters


@query("f1_uid_present", "select case when cast(substr(uid,2) as bigint)%5=0 then '' else uid end as uid, proto from {conn} where cast(substr(uid,2) as bigint)%5<>0 and cast(substr(uid,2) as bigint)%7<>0")
def f1(spark, sf) -> DataFrame:
    n = F.substring("uid", 2, 20).cast("bigint")
    holes = F.when(n % 5 == 0, "").when(n % 7 == 0, F.lit(None)).otherwise(F.col("uid"))
    return with_uid(view(spark, sf, "conn").select(holes.alias("uid"), "proto"))


@query("f2_noise_filter", "select uid, orig_pkts, resp_pkts from {conn} where coalesce(orig_pkts,0)+coalesce(resp_pkts,0) >= 3")
def f2(spark, sf) -> DataFrame:
    return drop_noise(view(spark, sf, "conn"), 3).select("uid", "orig_pkts", "resp_pkts")


@query("f3_alert_filter", "select uid, risk_score from {risk} where risk_score >= 65")
def f3(spark, sf) -> DataFrame:
    return alerts_only(inputs.scored(spark, sf)).select("uid", "risk_score")


@query("f4_benign_filter", "select uid, Attack as attack from {netflow} where Label = 0")
def f4(spark, sf) -> DataFrame:
    return benign_only(inputs.netflow(spark, sf)).select("uid", F.col("Attack").alias("attack"))


@query("f5_severity_filter", "select uid, severity from {risk} where risk_score >= 65 and severity = 'critical'")
def f5(spark, sf) -> DataFrame:
    return of_severity(inputs.fired(spark, sf), "critical").select("uid", "severity")


# ---- projections


@query(
    "p1_prefixed_side_log",
    "select uid, epoch_us(ts) as ssl_ts_us, version as ssl_version, cipher as ssl_cipher, server_name as ssl_server_name, ja3 as ssl_ja3, ja3s as ssl_ja3s, resumed as ssl_resumed, established as ssl_established from {ssl}",
)
def p1(spark, sf) -> DataFrame:
    side = prefixed(view(spark, sf, "ssl"), "ssl")
    return side.withColumn("ssl_ts_us", F.unix_micros(F.col("ssl_ts").cast("timestamp"))).drop("ssl_ts")


@query("p2_drop_identifiers", f"select {', '.join(f'round({n}, 6) as {n}' for n in FEATURE_NAMES)} from {{netflow}}")
def p2(spark, sf) -> DataFrame:
    rows = inputs.netflow(spark, sf).withColumn("IPV4_SRC_ADDR", F.col("uid")).withColumn("Dataset", F.lit("x"))
    return statistics.feature_matrix(rows.drop("uid", "ts")).select(*[F.round(n, 6).alias(n) for n in FEATURE_NAMES])


@query(
    "p3_clean_numerics",
    """select uid, case when x is null or isnan(x) or isinf(x) then 0 else least(3.4028234663852886e38, greatest(-3.4028234663852886e38, x)) end as x
from (select uid, case n%6 when 0 then cast('nan' as double) when 1 then cast('inf' as double) when 2 then cast('-inf' as double)
 when 3 then null when 4 then cast('-1e300' as double) else cast(orig_bytes as double) end as x
 from (select *, cast(substr(uid,2) as bigint) as n from {conn}) c) t""",
)
def p3(spark, sf) -> DataFrame:
    n = F.substring("uid", 2, 20).cast("bigint") % 6
    raw = (
        F.when(n == 0, float("nan")).when(n == 1, float("inf")).when(n == 2, float("-inf"))
        .when(n == 3, F.lit(None)).when(n == 4, -1e300).otherwise(F.col("orig_bytes").cast("double"))
    )
    return view(spark, sf, "conn").select("uid", clean_feature(raw).alias("x"))


@query(
    "p4_identities",
    """select uid, coalesce(case when n%4=0 then 'n' || n end, case when n%6<>0 then id_orig_h end, 'Unknown') as src_ip,
 coalesce(case when n%9=0 then 'm' || n end, id_resp_h, 'Unknown') as dst_ip,
 coalesce(nullif(case when n%4=0 then cast(n%3 as integer) end, 0), id_orig_p, 0) as src_port, id_resp_p as dst_port, proto as protocol
from (select *, cast(substr(uid,2) as bigint) as n from {conn}) c""",
)
def p4(spark, sf) -> DataFrame:
    n = F.substring("uid", 2, 20).cast("bigint")
    rows = view(spark, sf, "conn").withColumns(
        {
            "IPV4_SRC_ADDR": F.when(n % 4 == 0, F.concat(F.lit("n"), n)).otherwise(""),
            "IPV4_DST_ADDR": F.when(n % 9 == 0, F.concat(F.lit("m"), n)),
            "L4_SRC_PORT": F.when(n % 4 == 0, (n % 3).cast("int")),
            "id_orig_h": F.when(n % 6 != 0, F.col("id_orig_h")),
        }
    )
    return rows.select("uid", *[c.alias(k) for k, c in identities(rows).items()])


@query("p5_endpoints", "select uid, id_orig_h || ':' || id_orig_p as src, id_resp_h || ':' || id_resp_p as dst from {conn}")
def p5(spark, sf) -> DataFrame:
    rows = view(spark, sf, "conn")
    who = identities(rows)
    return rows.select(
        "uid",
        wording.endpoint(who["src_ip"], who["src_port"]).alias("src"),
        wording.endpoint(who["dst_ip"], who["dst_port"]).alias("dst"),
    )


@query("p6_flow_record", "select * from {traffic}")
def p6(spark, sf) -> DataFrame:
    return inputs.traffic(spark, sf)


# ---- joins

_J1 = "uid, proto, orig_bytes, ssl_version, ssl_cipher, ssl_ja3"


@query(
    "j1_conn_ssl_join",
    "select c.uid, c.proto, c.orig_bytes, s.version as ssl_version, s.cipher as ssl_cipher, s.ja3 as ssl_ja3 from {conn} c left join {ssl_dup} s on c.uid = s.uid",
)
def j1(spark, sf) -> DataFrame:
    return join_conn_ssl(view(spark, sf, "conn"), view(spark, sf, "ssl_dup")).select(*_J1.split(", "))


_J2_SQL = """
select c.uid, epoch_us(c.ts) as ts_us, c.proto, s.version as ssl_version, s.ja3 as ssl_ja3, d.query as dns_query, w.name as weird_name
from {conn} c left join {ssl} s on c.uid = s.uid and s.ts <= c.ts + interval '120' second
left join {dns} d on c.uid = d.uid left join {weird} w on c.uid = w.uid"""


def j2_logs(spark, sf) -> dict[str, DataFrame]:
    return {n: view(spark, sf, n) for n in ("conn", "ssl", "dns", "weird")}


def j2_columns(flows: DataFrame) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    return flows.select("uid", ts, "proto", "ssl_version", "ssl_ja3", "dns_query", "weird_name")


@query("j2_correlate_logs", _J2_SQL)
def j2(spark, sf) -> DataFrame:
    return j2_columns(correlate(j2_logs(spark, sf)))


@query("j3_ja3_threats", "select p.uid, p.ja3, t.malware as ja3_malware, t.severity from {printed} p join {threat_db} t on p.ja3 = t.ja3")
def j3(spark, sf) -> DataFrame:
    threats = intel.threat_table(spark)
    flows = intel.lookup_threats(inputs.fingerprints(spark, sf), threats).filter("ja3_malware is not null")
    return flows.join(threats.select("ja3", "severity"), "ja3").select("uid", "ja3", "ja3_malware", "severity")


@query("j4_ja3s_threats", "select p.uid, p.ja3s, t.malware as ja3s_malware from {printed} p left join {threat_db} t on p.ja3s = t.ja3 where p.ja3s is not null")
def j4(spark, sf) -> DataFrame:
    flows = intel.lookup_threats(inputs.fingerprints(spark, sf), intel.threat_table(spark))
    return flows.filter("ja3s is not null").select("uid", "ja3s", "ja3s_malware")


@query("j5_blocklist_flag", "select uid, ja3 in (select ja3 from {blocklist}) as listed from {printed}")
def j5(spark, sf) -> DataFrame:
    return inputs.fingerprints(spark, sf).select("uid", intel.in_blocklist(F.col("ja3")).alias("listed"))


@query(
    "j6_label_names",
    "select event_id, coalesce(l.name, 'Unknown Anomaly') as attack_type from {events} e left join (values "
    + ", ".join(f"({k}, '{v}')" for k, v in ATTACK_LABELS.items())
    + ") l(id, name) on e.event_id % 23 = l.id",
)
def j6(spark, sf) -> DataFrame:
    return view(spark, sf, "events").select("event_id", label_of(F.col("event_id") % 23).alias("attack_type"))


@query("j7_code_lookups", "select uid, PROTOCOL as protocol, L7_PROTO as l7_proto from {features}")
def j7(spark, sf) -> DataFrame:
    return view(spark, sf, "conn").select(
        "uid",
        code_of(F.col("proto"), PROTOCOL_NUMBERS).alias("protocol"),
        code_of(F.col("service"), SERVICE_IDS).alias("l7_proto"),
    )


# ---- features and scalar functions


@query("feat_flow_vector", f"select uid, {', '.join(f'round({n}, 6) as {n}' for n in FEATURE_NAMES)} from {{features}}")
def feat(spark, sf) -> DataFrame:
    return inputs.features(spark, sf).select("uid", *[F.round(n, 6).alias(n) for n in FEATURE_NAMES])


@query(
    "x1_safe_float",
    """select event_id, coalesce(case when isfinite(try_cast(raw as double)) then try_cast(raw as double) end, 0) as x
from (select event_id, case event_id%6 when 0 then 'nan' when 1 then 'inf' when 2 then 'n/a' when 3 then null else cast(value as string) end as raw from {events}) t""",
)
def x1(spark, sf) -> DataFrame:
    n = F.col("event_id") % 6
    raw = F.when(n == 0, "nan").when(n == 1, "inf").when(n == 2, "n/a").when(n == 3, F.lit(None)).otherwise(F.col("value").cast("string"))
    return view(spark, sf, "events").select("event_id", finite(raw).alias("x"))


@query("x2_tcp_flags", "select uid, cast(TCP_FLAGS as integer) as flags, cast(CLIENT_TCP_FLAGS as integer) as client_flags, cast(SERVER_TCP_FLAGS as integer) as server_flags from {features}")
def x2(spark, sf) -> DataFrame:
    h = F.col("history")
    return view(spark, sf, "conn").select(
        "uid", tcp_flags(h).alias("flags"), tcp_flags(h, "client").alias("client_flags"), tcp_flags(h, "server").alias("server_flags")
    )


@query("x3_retransmissions", "select uid, coalesce(length(history) - length(regexp_replace(history, '[cCtT]', '', 'g')), 0) as retransmissions from {conn}")
def x3(spark, sf) -> DataFrame:
    return view(spark, sf, "conn").select("uid", retransmissions(F.col("history")).cast("bigint").alias("retransmissions"))


@query("x4_ja3_hash", "select uid, md5(coalesce(version,'') || ',' || coalesce(cipher,'') || ',' || coalesce(server_name,'') || ',' || ',' || coalesce(ja3s,'')) as ja3 from {ssl}")
def x4(spark, sf) -> DataFrame:
    s = view(spark, sf, "ssl")
    none = F.lit(None).cast("string")
    return s.select("uid", tls.ja3_hash(s.version, s.cipher, s.server_name, none, s.ja3s).alias("ja3"))


@query("x5_ja3s_hash", "select uid, md5(coalesce(version,'') || ',' || coalesce(cipher,'') || ',' || coalesce(server_name,'')) as ja3s from {ssl}")
def x5(spark, sf) -> DataFrame:
    s = view(spark, sf, "ssl")
    return s.select("uid", tls.ja3s_hash(s.version, s.cipher, s.server_name).alias("ja3s"))


@query("x6_metadata_fingerprint", "select uid, ja3 from {printed} where is_pseudohash")
def x6(spark, sf) -> DataFrame:
    return inputs.fingerprints(spark, sf).filter("is_pseudohash").select("uid", "ja3")


@query("x7_no_tls_fingerprint", "select uid, ja3, has_tls, tls_threat from {tls} where not has_tls")
def x7(spark, sf) -> DataFrame:
    return inputs.analysed(spark, sf).filter(~F.col("has_tls")).select("uid", "ja3", "has_tls", "tls_threat")


@query("x8_tls_version_score", "select uid, tls_version, version_score from {judged} where has_tls")
def x8(spark, sf) -> DataFrame:
    f = inputs.fingerprints(spark, sf).filter("has_tls")
    return f.select("uid", "tls_version", tls.version_score(F.col("tls_version")).alias("version_score"))


@query("x9_weak_cipher", "select uid, tls_cipher, weak_cipher from {judged} where has_tls")
def x9(spark, sf) -> DataFrame:
    f = inputs.fingerprints(spark, sf).filter("has_tls")
    return f.select("uid", "tls_cipher", tls.weak_cipher(F.col("tls_cipher")).alias("weak_cipher"))


@query("x10_server_name_risk", "select uid, tls_server_name, cast(name_risk as double) as name_risk from {judged} where has_tls")
def x10(spark, sf) -> DataFrame:
    f = inputs.fingerprints(spark, sf).filter("has_tls")
    return f.select("uid", "tls_server_name", tls.server_name_risk(F.col("tls_server_name")).alias("name_risk"))


@query("x11_shannon_entropy", "select lab as label, round(ent, 9) as entropy from {entropies}")
def x11(spark, sf) -> DataFrame:
    first = F.substring_index("tls_server_name", ".", 1)
    names = inputs.fingerprints(spark, sf).filter("tls_server_name is not null").select(first.alias("label")).distinct()
    return names.filter("label <> ''").select("label", F.round(tls.shannon_entropy(F.col("label")), 9).alias("entropy"))


@query("x12_severity", "select event_id, case when event_id%101 >= 85 then 'critical' when event_id%101 >= 70 then 'high' when event_id%101 >= 65 then 'medium' else 'low' end as severity from {events}")
def x12(spark, sf) -> DataFrame:
    return view(spark, sf, "events").select("event_id", wording.severity(F.col("event_id") % 101).alias("severity"))


_EXPLAIN = """
select uid, case
 when tls_malicious and tls_threat <> '' then 'CRITICAL: Device ' || id_orig_h || ' used a TLS fingerprint (JA3) matching known malware ''' || tls_threat || '''. Connection to ' || id_resp_h || ' was flagged for immediate blocking.'
 when tls_malicious then 'CRITICAL: Device ' || id_orig_h || ' used an encrypted connection (JA3) identical to known malware. Blocked immediately.'
 when len(tls_factors) > 0 and risk_score > 85 then 'High-confidence threat from ' || id_orig_h || ' → ' || id_resp_h || '. TLS analysis: ' || array_to_string(tls_factors[1:2], '; ') || '. Network behavior strongly indicates an automated attack.'
 when len(tls_factors) > 0 then 'Suspicious activity from ' || id_orig_h || ' → ' || id_resp_h || ' (Risk: ' || risk_score || '). TLS indicators: ' || array_to_string(tls_factors[1:2], '; ') || '.'
 when risk_score > 85 then 'High-confidence anomaly detected from ' || id_orig_h || ' to ' || id_resp_h || '. Traffic volume and timing strongly indicate an automated attack.'
 else 'Suspicious network behavior detected from ' || id_orig_h || ' to ' || id_resp_h || ' (Risk Score: ' || risk_score || ').' end as explanation
from {risk}"""


@query("x13_explanation", _EXPLAIN)
def x13(spark, sf) -> DataFrame:
    return alert_records(inputs.scored(spark, sf)).select("uid", "explanation")


@query("x14_truncated_score", "select event_id, cast(floor(least(100, greatest(0, (value/200 - cast(0.1 as double))*100))) as integer) as score from {events}")
def x14(spark, sf) -> DataFrame:
    return view(spark, sf, "events").select("event_id", truncated_score(F.col("value") / 200 - F.lit(0.1)).alias("score"))


@query("x15_rounded_scores", "select uid, round_even(tls_risk, 3) as tls_risk_score, round_even(rf, 3) as random_forest from {risk}")
def x15(spark, sf) -> DataFrame:
    a = alert_records(inputs.scored(spark, sf))
    return a.select("uid", "tls_risk_score", F.col("detector_scores")["random_forest"].alias("random_forest"))


@query("x16_epoch_seconds", "select event_id, epoch_us(case when event_id%9<>0 then ts end)/1e6 as epoch from {events}")
def x16(spark, sf) -> DataFrame:
    some = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return view(spark, sf, "events").select("event_id", epoch_seconds(some).alias("epoch"))


@query("x17_label_ids", "select uid, Attack as attack, cast(dense_rank() over (order by Attack) - 1 as integer) as label_id from {netflow}")
def x17(spark, sf) -> DataFrame:
    rows = view(spark, sf, "train_labels").select("uid", "attack")
    return statistics.with_label_id(rows, "attack", statistics.label_ids(rows, "attack"))


# ---- TLS analysis, first sightings, intelligence merge, fusion


@query("w1_first_sightings", "select uid, ja3, first_seen from {judged}")
def w1(spark, sf) -> DataFrame:
    return with_first_seen(inputs.fingerprints(spark, sf)).select("uid", "ja3", "first_seen")


@query("k8_threat_precedence", "select * from {threat_db} union all select ja3, 'feed-only', 'critical', 'Abuse.ch SSLBL: feed-only (First seen: 2024-01-01)' from (select distinct ja3 from {ssl} where ja3 is not null) s where ja3 not in (select ja3 from {threat_db})")
def k8(spark, sf) -> DataFrame:
    feed = view(spark, sf, "ssl").filter("ja3 is not null").select("ja3").distinct().select(
        F.col("ja3").alias("ja3_md5"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-02-01").alias("last_seen"), F.lit("feed-only").alias("reason")
    )
    return intel.threat_table(spark, feed)


@query("r2_tls_risk", "select uid, cast(tls_risk as double) as tls_risk, tls_malicious, tls_threat, array_to_string(tls_factors, '|') as factors from {tls}")
def r2(spark, sf) -> DataFrame:
    return inputs.analysed(spark, sf).select(
        "uid", "tls_risk", "tls_malicious", "tls_threat", F.array_join("tls_risk_factors", "|").alias("factors")
    )


@query("r1_fused_score", "select uid, base_score from {risk}")
def r1(spark, sf) -> DataFrame:
    s = view(spark, sf, "scores")
    parts = {"isolation_forest": s.iso, "random_forest": s.rf, "transformer": s.seq, "statistical": F.col("stat")}
    return s.select("uid", truncated_score(fused_score(parts)).alias("base_score"))


@query("r3_tls_boost", "select uid, risk_score, tls_malicious as ja3_blocked from {risk}")
def r3(spark, sf) -> DataFrame:
    return inputs.scored(spark, sf).select("uid", "risk_score", "ja3_blocked")


@query("r4_attack_type", "select uid, attack_type from {risk}")
def r4(spark, sf) -> DataFrame:
    return inputs.scored(spark, sf).select("uid", "attack_type")


@query("r5_block_flag", "select uid, should_block from {risk}")
def r5(spark, sf) -> DataFrame:
    return inputs.scored(spark, sf).select("uid", "should_block")


_ALERT_SQL = f"""
select r.uid, epoch_us(ts)/1e6 as timestamp, id_orig_h || ':' || id_orig_p as src, id_resp_h || ':' || id_resp_p as dst, proto, risk_score, severity,
 attack_type, should_block, round_even(iso,3) as isolation_forest, round_even(rf,3) as random_forest, round_even(seq,3) as transformer, round_even(stat,3) as statistical,
 x.explanation, ja3, ja3s, tls_malicious as ja3_blocked, tls_version, round_even(tls_risk,3) as tls_risk_score, array_to_string(tls_factors,'|') as tls_risk_factors, tls_threat
from {{risk}} r join ({_EXPLAIN}) x on r.uid = x.uid where risk_score >= 65"""


@query("r6_alert_records", _ALERT_SQL)
def r6(spark, sf) -> DataFrame:
    a = alerts_only(alert_records(inputs.scored(spark, sf)))
    names = ["isolation_forest", "random_forest", "transformer", "statistical"]
    return (
        a.withColumns({n: F.col("detector_scores")[n] for n in names})
        .withColumn("tls_risk_factors", F.array_join("tls_risk_factors", "|"))
        .drop("detector_scores", "top_features")
    )


@query(
    "risk_unfitted_severity",
    """select severity, count(*) as alerts, max(risk_score) as top_score from (
 select case when s >= 85 then 'critical' when s >= 70 then 'high' else 'medium' end as severity, s as risk_score from (
  select case when tls_malicious then 100 else least(100, 47 + cast(floor(tls_risk*30) as integer)) end as s from {tls}) t where s >= 65) u group by severity""",
)
def flagship(spark, sf) -> DataFrame:
    """Alerts by severity with every detector untrained: only TLS evidence tells flows apart."""
    alerts = alerts_only(with_risk(inputs.analysed(spark, sf)))
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"), F.max("risk_score").alias("top_score"))


