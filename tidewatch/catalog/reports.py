"""Aggregates, ordered operators, top-k, dedup, samples and the block ledger."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.registry import query
from tidewatch.catalog.views import view
from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ewma import EwmaBaseline
from tidewatch.functions.flow_features import with_features
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators import kpi, sampling, statistics
from tidewatch.operators.intel import threat_table
from tidewatch.operators.ledger import active_blocks, block_ledger, blocked_count, blocking_events
from tidewatch.operators.ordered import entity_counts, ordered_blocks, sliding_windows, trailing_counts
from tidewatch.operators.risk import identities

# ---- totals and breakdowns


@query(
    "a1_traffic_totals",
    """select count(*) as flows_total, cast(sum(bytes_in) as bigint) as bytes_in_total, cast(sum(bytes_out) as bigint) as bytes_out_total,
 count(*) filter (where not is_malicious) as benign_count, count(*) filter (where is_malicious) as malicious_count from {traffic}""",
)
def a1(spark, sf) -> DataFrame:
    return kpi.traffic_totals(inputs.traffic(spark, sf))


@query("a2_alerts_total", "select count(*) as alerts_total from {risk} where risk_score >= 65 and attack_type <> 'Benign' and risk_score >= 20")
def a2(spark, sf) -> DataFrame:
    return kpi.alerts_total(inputs.fired(spark, sf))


@query("a3_protocol_breakdown", "select proto, count(*) as flows from {traffic} group by proto")
def a3(spark, sf) -> DataFrame:
    return kpi.protocol_breakdown(inputs.traffic(spark, sf))


@query(
    "a4_flow_rate",
    "select cast(floor(timestamp/60)*60 as bigint) as window_start, count(*) as flows, cast(floor(count(*)/60.0) as bigint) as flows_per_sec from {traffic} group by 1",
)
def a4(spark, sf) -> DataFrame:
    return kpi.flow_rate(inputs.traffic(spark, sf), 60)


@query(
    "a5_fingerprint_stats",
    "select count(distinct p.ja3) as unique_ja3_count, count(*) as total_fingerprinted, count(distinct t.ja3) as threats_detected from {printed} p left join {threat_db} t on p.ja3 = t.ja3",
)
def a5(spark, sf) -> DataFrame:
    return kpi.fingerprint_stats(inputs.fingerprints(spark, sf), threat_table(spark))


@query("a6_fingerprint_frequency", "select ja3, count(*) as hits from {printed} group by ja3")
def a6(spark, sf) -> DataFrame:
    return kpi.fingerprint_frequency(inputs.fingerprints(spark, sf))


_TOP6 = """
select attack_type, alerts, cast(round(alerts*100.0/sum(alerts) over ()) as integer) as share_pct from (
 select attack_type, count(*) as alerts from (select distinct uid, attack_type from {risk} where risk_score >= 65 and attack_type <> 'Benign') d
 group by attack_type order by alerts desc, attack_type limit 6) t"""


def _alert_rows(spark, sf) -> DataFrame:
    return inputs.fired(spark, sf).select("uid", F.col("ts").alias("timestamp"), "attack_type")


@query("a7_attack_share", _TOP6)
def a7(spark, sf) -> DataFrame:
    return kpi.attack_share(_alert_rows(spark, sf))


@query("k4_top_attack_types", "select attack_type, alerts from (" + _TOP6 + ") t")
def k4(spark, sf) -> DataFrame:
    return kpi.attack_share(_alert_rows(spark, sf)).select("attack_type", "alerts")


# ---- block ledger

_DAY_US = 86_400_000_000
_CHAIN = """
with recursive chain as (
 select ip, min(t) as t from {blocking} group by ip
 union all
 select c.ip, min(b.t) from chain c join {blocking} b on b.ip = c.ip and b.t >= c.t + @D group by c.ip)
select c.ip, c.t as start_us, c.t + @D as expiry_us, c.t + @D as end_us, b.score, 'auto' as source, 'expiry' as ended_by
from chain c join {blocking} b on b.ip = c.ip and b.t = c.t"""

# starts per ip and instant, an alert before a manual block of the same instant
_STARTS = """(select ip, t, min(kind) as kind, arg_min(score, kind) as score from (
 select ip, t, 0 as kind, score from {blocking}
 union all select ip, epoch_us(ts), 1, 100 from {actions} where action = 'block') s group by ip, t)"""
_MANUAL = f"""
with recursive starts as {_STARTS}, unblocks as (select distinct ip, epoch_us(ts) as t from {{actions}} where action = 'unblock'),
spans as (select s.*, min(u.t) as cut from starts s left join unblocks u on u.ip = s.ip and u.t >= s.t and u.t < s.t + @D group by s.ip, s.t, s.kind, s.score),
chain as (
 select ip, min(t) as t from spans group by ip
 union all
 select n.ip, min(b.t) from (select c.ip, coalesce(p.cut + 1, c.t + @D) as free from chain c join spans p on p.ip = c.ip and p.t = c.t) n
 join spans b on b.ip = n.ip and b.t >= n.free group by n.ip)
select c.ip, c.t as start_us, c.t + @D as expiry_us, coalesce(p.cut, c.t + @D) as end_us, p.score,
 case p.kind when 0 then 'auto' else 'manual' end as source, case when p.cut is null then 'expiry' else 'unblock' end as ended_by
from chain c join spans p on p.ip = c.ip and p.t = c.t"""


def _ledger(spark, sf, seconds: int, manual: bool) -> DataFrame:
    rows = block_ledger(
        blocking_events(inputs.scored(spark, sf)),
        view(spark, sf, "actions") if manual else None,
        Settings(block_seconds=seconds),
    )
    return rows.drop("carried")


query("w7_block_ledger", _CHAIN.replace("@D", str(1800 * 10**6)))(lambda spark, sf: _ledger(spark, sf, 1800, False))
query("w7_block_ledger_day", _CHAIN.replace("@D", str(_DAY_US)))(lambda spark, sf: _ledger(spark, sf, 86400, False))
query("w8_manual_actions", _MANUAL.replace("@D", str(_DAY_US)))(lambda spark, sf: _ledger(spark, sf, 86400, True))

# 2024-01-15 00:00 UTC, inside the data's month
_AT_US = 1_705_276_800_000_000


@query(
    "a8_active_blocks",
    "select ip, cast(floor((expiry_us - %d)/1000000.0) as bigint) as expires_in from (%s) l where start_us <= %d and end_us > %d"
    % (_AT_US, _CHAIN.replace("@D", str(_DAY_US)), _AT_US, _AT_US),
)
def a8(spark, sf) -> DataFrame:
    return active_blocks(_ledger(spark, sf, 86400, False), _AT_US)


@query(
    "a8_blocked_count",
    "select count(*) as blocked_count from (%s) l where start_us <= %d and end_us > %d" % (_CHAIN.replace("@D", str(_DAY_US)), _AT_US, _AT_US),
)
def a8_count(spark, sf) -> DataFrame:
    return blocked_count(_ledger(spark, sf, 86400, False), _AT_US)


# ---- training statistics

_LONG = "(" + " union all ".join(f"select '{n}' as feature, {n} as x from {{netflow}}" for n in FEATURE_NAMES) + ")"


@query("a9_feature_moments", f"select feature, round(avg(x), 4) as mean, round(stddev_pop(x) + 1e-8, 4) as std from {_LONG} l group by feature")
def a9(spark, sf) -> DataFrame:
    m = statistics.moments(inputs.netflow(spark, sf))
    return m.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_SCALED = ("IN_BYTES", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "TCP_FLAGS", "FTP_COMMAND_RET_CODE")


@query(
    "a10_standard_scaler",
    "select uid, "
    + ", ".join(f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 6) + 0 as {c}" for c in _SCALED)
    + " from {netflow}",
)
def a10(spark, sf) -> DataFrame:
    rows = inputs.netflow(spark, sf)
    stats = statistics.collect_moments(rows)
    scaled = statistics.standardised(rows, stats, scaler=True)
    return scaled.select("uid", *[(F.round(c, 6) + 0).alias(c) for c in _SCALED])


@query(
    "a11_percentile_threshold",
    "select round(quantile_cont(IN_BYTES, cast(0.95 as double)), 6) as p95, round(avg(IN_BYTES), 4) as mean, round(stddev_pop(IN_BYTES), 4) as std, max(IN_BYTES) as max from {features}",
)
def a11(spark, sf) -> DataFrame:
    f = inputs.features(spark, sf)
    p95 = statistics.exact_percentile(f, "IN_BYTES", 0.95)
    return f.agg(
        F.round(F.lit(p95), 6).alias("p95"),
        F.round(F.avg("IN_BYTES"), 4).alias("mean"),
        F.round(F.stddev_pop("IN_BYTES"), 4).alias("std"),
        F.max("IN_BYTES").alias("max"),
    )


@query(
    "a12_class_weights",
    "select attack, count(*) as rows, round(sum(count(*)) over () / cast(count(*) over () * count(*) as double), 9) as weight from {train_labels} group by attack",
)
def a12(spark, sf) -> DataFrame:
    w = statistics.class_weights(view(spark, sf, "train_labels"), "attack")
    return w.select("attack", "rows", F.round("weight", 9).alias("weight"))


# ---- order-dependent operators


@query("w2_stat_ewma", "select n.uid, round(s.score, 6) as statistical_score from {ewma_rows} n join {ewma_score} s on n.rn = s.rn")
def w2(spark, sf) -> DataFrame:
    scored, _ = EwmaBaseline().score(ordered_blocks(inputs.features(spark, sf)))
    return scored.select("uid", F.round("statistical_score", 6).alias("statistical_score"))


@query(
    "w2_stat_entity",
    "select n.uid, n.entity, round(s.score, 6) as statistical_score from {service_rows} n join {service_score} s on n.rn = s.rn and n.entity = s.entity",
)
def w2_entity(spark, sf) -> DataFrame:
    """A baseline of its own for every service; each has many more rows than a block's share."""
    rows = with_features(view(spark, sf, "conn"))
    service = F.concat(F.col("proto"), F.lit(":"), F.col("id_resp_p").cast("string")).alias("entity")
    blocks = ordered_blocks(rows.select("uid", "ts", service, *FEATURE_NAMES), entity=("entity",))
    return EwmaBaseline().score_entities(blocks).select("uid", "entity", F.round("statistical_score", 6).alias("statistical_score"))


_LAST_STATE = "select feature, rn + 1 as flows, round(mean_after, 4) as mean, round(ln(1 + var_after), 6) as ln_var from {ewma_var} where rn = (select max(rn) from {ewma_rows})"


def baseline_rows(spark, state) -> DataFrame:
    rows = [(n, state.n, m, v) for n, m, v in zip(FEATURE_NAMES, state.mean, state.var, strict=True)]
    df = spark.createDataFrame(rows, "feature string, flows bigint, mean double, var double")
    return df.select("feature", "flows", F.round("mean", 4).alias("mean"), F.round(F.log1p("var"), 6).alias("ln_var"))


@query("stat_baseline_fit", _LAST_STATE)
def stat_fit(spark, sf) -> DataFrame:
    return baseline_rows(spark, EwmaBaseline().fit(ordered_blocks(inputs.features(spark, sf))))


@query(
    "w3_sliding_sequences",
    """select uid, position, total_bytes, first_bytes from (select uid, rn as position, count(*) over w as n,
 sum(IN_BYTES) over w as total_bytes, first_value(IN_BYTES) over w as first_bytes
 from {ewma_rows} window w as (order by rn rows between 9 preceding and current row)) t where n = 10""",
)
def w3(spark, sf) -> DataFrame:
    windows = sliding_windows(ordered_blocks(inputs.features(spark, sf)), 10, ["IN_BYTES", "OUT_BYTES"], bucket_rows=2_000)
    return windows.select(
        "uid",
        F.col("_position").alias("position"),
        F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x[0]).alias("total_bytes"),
        F.col("window")[0][0].alias("first_bytes"),
    )


@query("w4_trailing_buffer", "select uid, least(rn + 1, 10) as buffered, case when rn + 1 < 10 then cast(0.5 as double) end as untrained_score from {ewma_rows}")
def w4(spark, sf) -> DataFrame:
    held = trailing_counts(ordered_blocks(inputs.features(spark, sf)), DEFAULTS.sequence_length)
    return held.select("uid", "buffered", F.when(F.col("buffered") < 10, F.lit(0.5)).alias("untrained_score"))


@query(
    "w4_entity_buffer",
    """select uid, id_orig_h, least(rn, 10) as buffered, case when rn < 10 then cast(0.5 as double) end as untrained_score
 from (select uid, id_orig_h, row_number() over (partition by id_orig_h order by ts, uid) as rn from {conn}) t""",
)
def w4_entity(spark, sf) -> DataFrame:
    conn = view(spark, sf, "conn").select("uid", "ts", "id_orig_h")
    held = entity_counts(ordered_blocks(conn, entity=("id_orig_h",)), DEFAULTS.sequence_length)
    return held.select("uid", "id_orig_h", "buffered", F.when(F.col("buffered") < 10, F.lit(0.5)).alias("untrained_score"))


def _activity_rows(spark, sf) -> DataFrame:
    t = view(spark, sf, "conn")
    who = identities(t)
    return t.select(
        who["src_ip"].alias("src_ip"), who["dst_ip"].alias("dst_ip"), who["dst_port"].alias("dst_port"),
        F.col("orig_bytes").alias("bytes_in"), F.col("resp_bytes").alias("bytes_out"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
    )


@query(
    "w5_flow_windows",
    """select id_orig_h as src_ip, cast(floor(epoch_us(ts)/1e6/30)*30 as bigint) as window_start, count(*) as flows, cast(sum(orig_bytes) as bigint) as bytes_in,
 cast(sum(resp_bytes) as bigint) as bytes_out, count(distinct id_resp_h) as distinct_destinations, count(distinct id_resp_p) as distinct_ports from {conn} group by 1, 2""",
)
def w5(spark, sf) -> DataFrame:
    return kpi.source_activity(_activity_rows(spark, sf))


@query(
    "w6_rate_history",
    """select s.w as window_start, coalesce(c.n, 0) as flows, cast(floor(coalesce(c.n, 0)/60.0) as bigint) as flows_per_sec
from (select unnest(range(cast(floor(max(epoch_us(ts))/60e6)*60 as bigint) - 59*60, cast(floor(max(epoch_us(ts))/60e6)*60 as bigint) + 60, 60)) as w from {conn}) s
left join (select cast(floor(epoch_us(ts)/60e6)*60 as bigint) as w, count(*) as n from {conn} group by 1) c on s.w = c.w""",
)
def w6(spark, sf) -> DataFrame:
    return kpi.rate_history(inputs.traffic(spark, sf), 60, 60)


# ---- top-k, dedup, concatenation, samples


@query("k1_recent_alerts", "select uid, severity, risk_score from (select * from {risk} where risk_score >= 65 order by ts desc, uid limit 200) f where severity = 'high' order by ts desc, uid limit 50")
def k1(spark, sf) -> DataFrame:
    alerts = inputs.fired(spark, sf).withColumn("timestamp", F.col("ts"))
    return kpi.recent_alerts(alerts, severity="high").select("uid", "severity", "risk_score")


@query("k2_recent_flows", "select uid, timestamp, bytes_in from {traffic} order by timestamp desc, uid limit 100")
def k2(spark, sf) -> DataFrame:
    return kpi.recent_flows(inputs.traffic(spark, sf)).select("uid", "timestamp", "bytes_in")


@query("k3_top_fingerprints", "select ja3, hits from (select ja3, count(*) as hits, min((ts, uid)) as first from {printed} group by ja3 order by hits desc, first limit 10) t")
def k3(spark, sf) -> DataFrame:
    return kpi.top_fingerprints(inputs.fingerprints(spark, sf))


@query(
    "k6_dedup_by_uid",
    "select uid, epoch_us(ts) as ts_us, version from (select *, row_number() over (partition by uid order by ts) as rn from {ssl_dup}) t where rn = 1",
)
def k6(spark, sf) -> DataFrame:
    d = sampling.first_per_uid(view(spark, sf, "ssl_dup"), ["ts"])
    return d.select("uid", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "version")


@query("k7_concatenate", "select uid, version from {ssl} union all select uid, qtype_name from {dns}")
def k7(spark, sf) -> DataFrame:
    a = view(spark, sf, "ssl").select("uid", "version")
    b = view(spark, sf, "dns").select(F.col("qtype_name").alias("version"), "uid")
    return sampling.concatenate([a, b])


_UNIT = "cast(('0x' || substr(md5(uid || ':42'), 1, 8)) as bigint) / 4294967296.0"


@query("k9_sample", f"select uid, attack, label from {{train_labels}} where {_UNIT} < 0.05")
def k9(spark, sf) -> DataFrame:
    return sampling.sample_fraction(view(spark, sf, "train_labels"), 0.05, 42)


@query("k9_benign_sample", f"select uid from {{train_labels}} where label = 0 and {_UNIT} < 0.01")
def k9_benign(spark, sf) -> DataFrame:
    benign = view(spark, sf, "train_labels").filter("label = 0")
    return sampling.sample_fraction(benign, 0.01, DEFAULTS.seed).select("uid")


@query("k10_train_test_split", f"select uid, label, case when {_UNIT} < 0.2 then 'test' else 'train' end as part from {{train_labels}}")
def k10(spark, sf) -> DataFrame:
    train, test = sampling.train_test_split(view(spark, sf, "train_labels"), DEFAULTS.test_fraction, DEFAULTS.seed)
    parts = [df.select("uid", "label", F.lit(p).alias("part")) for df, p in ((train, "train"), (test, "test"))]
    return sampling.concatenate(parts)


@query(
    "k10_sequence_split",
    """select part, count(*) as sequences from (select case when cast(('0x' || substr(md5(cast(floor(rn/1000) as bigint) || ':42'), 1, 8)) as bigint) / 4294967296.0 < 0.1 then 'validation' else 'train' end as part
 from {ewma_rows} where rn >= 9) t group by part""",
)
def k10_sequences(spark, sf) -> DataFrame:
    windows = sliding_windows(ordered_blocks(inputs.features(spark, sf)), 10)
    split = partial(sampling.split_by_block, position=F.col("_position"), block=1000, fraction=0.1, seed=42)
    train, held = split(windows)
    both = sampling.concatenate([df.select(F.lit(p).alias("part")) for df, p in ((train, "train"), (held, "validation"))])
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("sequences"))
