"""Sources and sinks, models, and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.registry import QUERIES, query
from tidewatch.catalog.relational import _J2_SQL, j2_columns
from tidewatch.catalog.reports import _CHAIN, _DAY_US, _LAST_STATE, _MANUAL, baseline_rows
from tidewatch.catalog.views import VIEWS, view
from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ensemble import DetectorSet, fit_detectors
from tidewatch.detectors.ewma import EwmaBaseline, EwmaState
from tidewatch.detectors.forest import AttackForest, attack_score, best_class, best_other_class
from tidewatch.detectors.isolation import _EULER, IsolationForest, IsolationForestModel
from tidewatch.detectors.sequence import SequenceDetector, SequenceModel
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators import evaluation
from tidewatch.operators.filters import alerts_only, benign_only
from tidewatch.operators.intel import feed_threats, threat_table
from tidewatch.operators.ledger import block_ledger, blocking_events
from tidewatch.operators.ordered import ordered_blocks
from tidewatch.operators.risk import alert_records
from tidewatch.plans.train import train
from tidewatch.sources.intel_feed import load_feed, read_feed, refresh_snapshot
from tidewatch.sources.logs import read_conn_log, read_log, read_ssl_log, stream_log, write_text_log
from tidewatch.sources.schemas import LOG_FIELDS
from tidewatch.sources.sinks import write_by_day, write_json
from tidewatch.sources.storage import materialise, scratch_path, spread, stored_table
from tidewatch.sources.training import read_training_csv
from tidewatch.streaming import running
from tidewatch.streaming.correlate import correlate_early, correlate_stream
from tidewatch.streaming.ledger import ledger_stream
from tidewatch.streaming.live import LiveScoring, live_flows
from tidewatch.streaming.reports import (
    dedup_stream,
    first_sighting_state,
    first_sightings_known,
    flow_rate_stream,
    new_fingerprints,
    source_activity_stream,
)
from tidewatch.streaming.run import drain_changes, drain_in_turn, drain_to_table


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")


# ---- sources and sinks

_CONN = "uid, epoch_us(ts) as ts_us, id_orig_h, id_orig_p, id_resp_h, id_resp_p, proto, service, duration, orig_bytes, resp_bytes, orig_pkts, resp_pkts, orig_ip_bytes, resp_ip_bytes, conn_state, history, missed_bytes"


def _written(spark: SparkSession, sf: str, log: str) -> str:
    """The log as files of two sensors: other column orders, and one has a column that the log does not know."""
    path, rows = scratch_path(spark, f"{log}-log"), view(spark, sf, log)
    one = F.crc32(F.col("uid").cast("binary")) % 2 == 0
    write_text_log(rows.filter(one), path, log)
    other = rows.filter(~one).withColumn("site", F.lit("b"))
    write_text_log(other, path, log, ["site", *reversed([n for n in LOG_FIELDS[log] if n in rows.columns])], "append")
    return path


@query("s1_conn_log", f"select {_CONN} from {{conn}}")
def s1(spark, sf) -> DataFrame:
    rows = read_conn_log(spark, _written(spark, sf, "conn"))
    return rows.withColumn("ts_us", _us("ts")).drop("ts")


@query(
    "s2_ssl_log",
    "select uid, epoch_us(ts) as ts_us, case when version <> '-' then version end as version, cipher, cast(null as string) as curve, server_name, case when ja3 <> '-' then ja3 end as ja3, case when ja3s <> '-' then ja3s end as ja3s, resumed, established from {ssl}",
)
def s2(spark, sf) -> DataFrame:
    rows = read_ssl_log(spark, _written(spark, sf, "ssl"))
    return rows.withColumn("ts_us", _us("ts")).drop("ts", "cert_chain_fuids")


@query("s3_continuous_log", "select uid, epoch_us(ts) as ts_us, query, qtype_name, rcode_name from {dns}")
def s3(spark, sf) -> DataFrame:
    path = _written(spark, sf, "dns")
    stream = stream_log(spark, path, "dns")
    arrived = drain_to_table(stream.filter("uid is not null"), "dns-arrived")
    return arrived.select("uid", _us("ts"), "query", "qtype_name", "rcode_name")


@query("s4_field_selection", "select uid, name, notice from {weird}")
def s4(spark, sf) -> DataFrame:
    return read_log(spark, _written(spark, sf, "weird"), "weird").select("uid", "name", "notice")


@query("s5_training_csv", "select Attack as attack, Label as label, count(*) as rows, sum(IN_BYTES) as in_bytes, sum(TCP_FLAGS) as flags from {netflow} group by Attack, Label")
def s5(spark, sf) -> DataFrame:
    path = scratch_path(spark, "training")
    named = inputs.netflow(spark, sf).select(
        F.col("uid").alias("IPV4_SRC_ADDR"), F.lit(1).alias("L4_SRC_PORT"), F.lit("d").alias("IPV4_DST_ADDR"), F.lit(2).alias("L4_DST_PORT"),
        *FEATURE_NAMES, "Label", "Attack", F.lit("given").alias("Dataset"),
    )
    named.write.csv(path, header=True)
    rows = read_training_csv(spark, path)
    return rows.groupBy(F.col("Attack").alias("attack"), F.col("Label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("IN_BYTES").alias("in_bytes"), F.sum("TCP_FLAGS").alias("flags")
    )


def _feed_file(spark: SparkSession, sf: str) -> str:
    """A feed in its file format, from the fingerprints of the data; some lines are too short or no hash."""
    path = scratch_path(spark, "feed")
    seen = view(spark, sf, "ssl").filter("ja3 is not null").groupBy("ja3").agg(F.count(F.lit(1)).alias("n"))
    line = (
        F.when(F.col("n") % 5 == 0, F.concat(F.lit("# "), "ja3"))
        .when(F.col("n") % 5 == 1, F.concat("ja3", F.lit(",2024-01-01")))
        .when(F.col("n") % 5 == 2, F.concat(F.lit("x"), "ja3", F.lit(",2024-01-01,2024-02-01,odd")))
        .otherwise(F.concat("ja3", F.lit(",2024-01-01,2024-02-01,family-"), F.col("n") % 5))
    )
    seen.select(line.alias("value")).write.text(path)
    return path


_FEED = "select ja3 as ja3_md5, '2024-01-01' as first_seen, '2024-02-01' as last_seen, 'family-' || (n%5) as reason from (select ja3, count(*) as n from {ssl} where ja3 is not null group by ja3) s where n%5 >= 3"


@query("s6_ja3_feed", _FEED)
def s6(spark, sf) -> DataFrame:
    return read_feed(spark, _feed_file(spark, sf))


@query("s7_feed_snapshot", f"select ja3_md5 as ja3, reason as malware, 'Abuse.ch SSLBL: ' || reason || ' (First seen: 2024-01-01)' as description from ({_FEED}) f")
def s7(spark, sf) -> DataFrame:
    """Feed kept as a snapshot, then loaded although the feed itself is gone."""
    snapshot = scratch_path(spark, "snapshot")
    refresh_snapshot(spark, _feed_file(spark, sf), snapshot)
    kept = load_feed(spark, f"{snapshot}-no-such-feed", snapshot)
    return feed_threats(kept).select("ja3", "malware", "description")


@query("s8_alert_json", "select uid, epoch_us(ts)/1e6 as timestamp, risk_score, severity, round_even(rf,3) as random_forest, array_to_string(tls_factors, '|') as factors from {risk} where risk_score >= 65")
def s8(spark, sf) -> DataFrame:
    path = scratch_path(spark, "alerts-json")
    alerts = alerts_only(alert_records(inputs.scored(spark, sf)))
    write_json(alerts, path)
    back = spark.read.schema(alerts.schema).json(path)
    return back.select(
        "uid", "timestamp", "risk_score", "severity",
        F.col("detector_scores")["random_forest"].alias("random_forest"), F.array_join("tls_risk_factors", "|").alias("factors"),
    )


@query("s9_flow_sink", "select cast(day as string) as day, count(*) as flows, cast(sum(bytes_in) as bigint) as bytes_in from (select *, cast(make_timestamp(cast(timestamp*1e6 as bigint)) as date) as day from {traffic}) t group by day")
def s9(spark, sf) -> DataFrame:
    path = scratch_path(spark, "traffic")
    write_by_day(inputs.traffic(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes_in").alias("bytes_in")
    )


@query("s10_model_persistence", _LAST_STATE)
def s10(spark, sf) -> DataFrame:
    path = scratch_path(spark, "models")
    DetectorSet(baseline=EwmaBaseline().fit(ordered_blocks(inputs.features(spark, sf)))).save(spark, path)
    return baseline_rows(spark, DetectorSet.load(spark, path).baseline)


# ---- models: scores depend on random draws, so SQL checks their range and completeness

def _in_unit(c: str):
    return (F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) <= 1)).alias("in_range")


@query("d_iso_scores", "select uid, true as in_range from {conn}")
def d_iso(spark, sf) -> DataFrame:
    rows = spread(materialise(inputs.netflow(spark, sf)))
    path = scratch_path(spark, "isolation")
    IsolationForest().fit(benign_only(rows)).save(spark, path)
    return IsolationForestModel.load(spark, path).transform(rows).select("uid", _in_unit("isolation_forest_score"))


@query("d_iso_contamination", "select distinct 'benign' as part, cast(0.01 as double) as above_boundary from {conn}")
def d_iso_share(spark, sf) -> DataFrame:
    """By construction one benign row in a hundred lies beyond the decision boundary."""
    benign = materialise(benign_only(inputs.netflow(spark, sf)))
    scored = IsolationForest().fit(benign).transform(benign)
    share = F.round(F.avg(F.when(F.col("isolation_forest_score") > 0.5, 1.0).otherwise(0.0)), 2)
    return scored.agg(F.lit("benign").alias("part"), share.alias("above_boundary"))


def _forest(spark, sf):
    rows = spread(materialise(inputs.netflow(spark, sf)))
    return AttackForest().fit(rows), rows


@query("d_rf_scores", "select uid, true as in_range, true as known_label, true as other_is_attack from {conn}")
def d_rf(spark, sf) -> DataFrame:
    model, rows = _forest(spark, sf)
    names = list(model.labels.values())
    return model.transform(rows).select(
        "uid",
        _in_unit("random_forest_score"),
        F.col("attack_label").isin(*names).alias("known_label"),
        (F.col("alternative_label") != "Benign").alias("other_is_attack"),
    )


_P = "[value/1000, (event_id%7)/10.0e0, (event_id%5)/10.0e0, (event_id%3)/10.0e0]"


@query(
    "d_rf_class_choice",
    f"""select event_id, 1 - p[3] as score, cast(list_position(p, list_aggregate(p,'max')) - 1 as integer) as best,
 cast(case when greatest(p[1],p[2],p[4]) = p[1] then 0 when greatest(p[1],p[2],p[4]) = p[2] then 1 else 3 end as integer) as best_other
from (select event_id, {_P} as p from {{events}}) t""",
)
def d_rf_choice(spark, sf) -> DataFrame:
    labels = {0: "Analysis", 1: "Backdoor", 2: "Benign", 3: "Bot"}
    p = F.array(F.col("value") / 1000, F.col("event_id") % 7 / F.lit(10.0), F.col("event_id") % 5 / F.lit(10.0), F.col("event_id") % 3 / F.lit(10.0))
    return view(spark, sf, "events").select(
        "event_id", attack_score(p, labels).alias("score"), best_class(p).alias("best"), best_other_class(p, labels).alias("best_other")
    )


@query(
    "k5_feature_importances",
    f"select unnest([{', '.join(repr(n) for n in FEATURE_NAMES)}]) as feature, true as non_negative, true as sum_is_one, true as ranked",
)
def k5(spark, sf) -> DataFrame:
    """All importances; the best five, as the report ranks them, are the first five by value."""
    model, _ = _forest(spark, sf)
    rows = model.importances(spark)
    total = rows.agg(F.sum("importance").alias("s"))
    best = [n for n, _ in model.top_features(5)]
    least = rows.filter(F.col("feature").isin(best)).agg(F.min("importance").alias("m"))
    ranked = F.col("feature").isin(best) | (F.col("importance") <= F.col("m"))
    return rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(least)).select(
        "feature", (F.col("importance") >= 0).alias("non_negative"), (F.abs(F.col("s") - 1) < 1e-9).alias("sum_is_one"), ranked.alias("ranked")
    )


@query("d_seq_scores", "select uid, true as in_range, case when rn < 9 then cast(0.5 as double) end as warmup_score from {ewma_rows}")
def d_seq(spark, sf) -> DataFrame:
    rows = inputs.netflow(spark, sf)
    ordered = ordered_blocks(rows)
    model = SequenceDetector().fit(benign_only(ordered.rows.drop("_block", "_row")))
    placed = ordered.with_position().select("uid", "_position")
    scored = model.transform(ordered).select("uid", "sequence_score").join(placed, "uid")
    warmup = F.when(F.col("_position") < 9, F.col("sequence_score")).alias("warmup_score")
    return scored.select("uid", _in_unit("sequence_score"), warmup)


_PATHS = """case when IN_BYTES <= 5000 then 2.0e0 when OUT_BYTES <= 8000 then 2.0e0 else 3.0e0 end + case when IN_PKTS <= 20 then 1.0e0 else 2.5e0 end"""


@query(
    "d_iso_given_trees",
    f"""select uid, round(greatest(0.0e0, least(1.0e0, 0.5e0 + power(2.0e0, -(paths / 2) / (2*(ln(3.0e0) + {_EULER!r}) - 1.5e0)) - 0.55e0)), 9) as isolation_forest_score
from (select uid, {_PATHS} as paths from {{netflow}}) t""",
)
def d_iso_given(spark, sf) -> DataFrame:
    """Two given trees over samples of four: the score is checked by value."""
    nodes = [
        (0, 0, 0, 5000.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 2.0), (0, 2, 1, 8000.0, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 2.0), (0, 4, -1, 0.0, -1, -1, 3.0),
        (1, 0, 2, 20.0, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 1.0), (1, 2, -1, 0.0, -1, -1, 2.5),
    ]
    frame = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "below", "above", "path"])
    model, path = IsolationForestModel(frame, 4, -0.55, ["IN_BYTES", "OUT_BYTES", "IN_PKTS"]), scratch_path(spark, "given-trees")
    model.save(spark, path)
    scored = IsolationForestModel.load(spark, path).transform(inputs.netflow(spark, sf))
    return scored.select("uid", F.round("isolation_forest_score", 9).alias("isolation_forest_score"))


@query(
    "d_seq_given_components",
    """select uid, case when rn < 2 then 0.5e0 else round(least(1.0e0, (q - t*t/6 - d*d/6) / 6 / 2), 6) end as sequence_score from (
 select uid, rn, sum(a + b) over w as t, sum(a - b) over w as d, sum(a*a + b*b) over w as q
 from (select uid, rn, (IN_BYTES - 4000.3e0) / 3001.7e0 as a, (OUT_BYTES - 6000.9e0) / 5003.1e0 as b from {ewma_rows}) x window w as (order by rn rows between 2 preceding and current row)) s""",
)
def d_seq_given(spark, sf) -> DataFrame:
    """Two given components of windows of three flows: the part of a window that they don't rebuild is checked by value."""
    part = 6**-0.5
    model = SequenceModel([4000.3, 6000.9], [3001.7, 5003.1], [[part, part], [part, -part]] * 3, 2.0, 3, ["IN_BYTES", "OUT_BYTES"])
    path = scratch_path(spark, "given-components")
    model.save(spark, path)
    scored = SequenceModel.load(spark, path).transform(ordered_blocks(inputs.netflow(spark, sf).select("ts", "uid", *model.features)))
    return scored.select("uid", F.round("sequence_score", 6).alias("sequence_score"))


_KIND = "case when IN_BYTES < 4000 then 0 when IN_BYTES < 8000 then 1 else 2 end"


@query(
    "d_rf_given_classes",
    f"""select uid, case kind when 0 then 0.0e0 else 1.0e0 end as random_forest_score, case kind when 0 then 'Benign' when 1 then 'DDoS' else 'Exploits' end as attack_label,
 case kind when 2 then 'Exploits' else 'DDoS' end as alternative_label from (select uid, {_KIND} as kind from {{netflow}}) t""",
)
def d_rf_given(spark, sf) -> DataFrame:
    """Classes that one column tells apart: every forest knows them for certain, so score and both labels are checked by value."""
    rows = inputs.netflow(spark, sf).select("uid", F.expr(_KIND).cast("double").alias("kind")).withColumn("Attack", F.expr("element_at(array('Benign', 'DDoS', 'Exploits'), cast(kind as int) + 1)"))
    rows = stored_table(rows, "kinds")
    model = AttackForest(Settings(rf_trees=5, rf_depth=2), ("kind",)).fit(rows)
    return model.transform(rows).select("uid", F.round("random_forest_score", 9).alias("random_forest_score"), "attack_label", "alternative_label")


_SCORED = """(select unnest(['iso', 'rf', 'seq', 'stat']) as detector, unnest([iso, rf, seq, stat]) as score, l.label = 1 as positive
 from {scores} s join {train_labels} l on s.uid = l.uid) t"""


def _scores_and_labels(spark, sf) -> DataFrame:
    return view(spark, sf, "scores").select("uid", "iso", "rf", "seq", "stat").join(view(spark, sf, "train_labels").select("uid", (F.col("label") == 1).alias("positive")), "uid")


@query(
    "r7_evaluation",
    f"""select detector, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives,
 round(cast(sum(pos * (2 * below + neg)) as double) / (2.0e0 * cast(sum(pos) as double) * cast(sum(neg) as double)), 9) as auc
from (select *, coalesce(sum(neg) over (partition by detector order by score rows between unbounded preceding and 1 preceding), 0) as below
 from (select detector, score, count(*) filter (where positive) as pos, count(*) filter (where not positive) as neg from {_SCORED} group by 1, 2) g) c group by detector""",
)
def r7_evaluation(spark, sf) -> DataFrame:
    return evaluation.ranking_quality(_scores_and_labels(spark, sf), ["iso", "rf", "seq", "stat"], "positive").withColumn("auc", F.round("auc", 9))


@query(
    "r7_calibration",
    f"""select detector, cast(greatest(0, least(9, floor(score * 10))) as integer) as bin, count(*) as rows, round(avg(score), 9) as mean_score,
 round(avg(case when positive then 1.0e0 else 0.0e0 end), 9) as positive_share from {_SCORED} group by 1, 2""",
)
def r7_calibration(spark, sf) -> DataFrame:
    bins = evaluation.calibration(_scores_and_labels(spark, sf), ["iso", "rf", "seq", "stat"], "positive")
    return bins.select("detector", "bin", "rows", F.round("mean_score", 9).alias("mean_score"), F.round("positive_share", 9).alias("positive_share"))


@query(
    "r7_train_all",
    "select Attack as actual, count(*) as rows, true as known_labels from {netflow} where cast(('0x' || substr(md5(uid || ':42'), 1, 8)) as bigint) / 4294967296.0 < 0.2 group by Attack",
)
def r7(spark, sf) -> DataFrame:
    """The training job: clean, split by hash of the uid, fit all four on real settings, keep, confusion of the held-out part."""
    done = train(inputs.netflow(spark, sf), DEFAULTS, scratch_path(spark, "trained"), key=("uid",))
    return done.confusion().groupBy("actual").agg(F.sum("rows").alias("rows"), (F.count_if(~F.col("predicted").isin(*done.detectors.forest.labels.values())) == 0).alias("known_labels"))


# ---- streams


def _events_stream(spark: SparkSession, sf: str, closing: bool = False) -> DataFrame:
    """The events table as a stream. ``closing`` adds one far-future row, after which every session
    of the data is closed."""
    events = view(spark, sf, "events")
    if closing:
        last = events.agg(F.max("ts").alias("ts")).select(
            F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("interval 10 days")).cast("timestamp_ntz").alias("ts"),
            F.lit(0).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props"),
        )
        path = scratch_path(spark, "events")
        events.unionByName(last).write.parquet(path)
        return spark.readStream.schema(events.schema).parquet(path)
    return spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")


def _stream_view(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    if name == "ssl_dup":
        ssl = _stream_view(spark, events, "ssl")
        return ssl.unionByName(ssl.filter("cast(substr(uid,2) as bigint)%211=0"))
    return spark.sql(VIEWS[name], events=events).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream_logs(spark, sf) -> dict[str, DataFrame]:
    events = _events_stream(spark, sf, closing=True)
    return {n: _stream_view(spark, events, n) for n in ("conn", "ssl", "dns", "weird")}


@query("j2_stream_sessions", _J2_SQL)
def j2_stream(spark, sf) -> DataFrame:
    return j2_columns(drain_to_table(correlate_stream(_stream_logs(spark, sf)), "sessions"))


@query("j2_stream_early", "select c.uid, epoch_us(c.ts) as ts_us, c.proto, s.version as ssl_version from {conn} c left join {ssl} s on c.uid = s.uid")
def j2_early(spark, sf) -> DataFrame:
    """All logs arrive in one batch here, so the early form sees every TLS record before its timers."""
    flows = drain_to_table(correlate_early(_stream_logs(spark, sf)), "early")
    return flows.filter("uid <> 'C-1'").select("uid", _us("ts"), "proto", "ssl_version")


# records arrive by fifths of the time range, TLS records or connections of some uids one or two parts late; event time runs a part and a half behind
_EARLY_PARTS = """select * from (with b as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from {conn}),
 r as (select c.uid, c.proto, s.version, epoch_us(c.ts) as t, epoch_us(s.ts) as tls, (hi - lo + 1) * 3 // 10000000 * 1000 as behind,
  (epoch_us(c.ts) - lo) * 5 // (hi - lo + 1) + case cast(substr(c.uid, 2) as bigint) % 5 when 3 then 1 when 4 then 2 else 0 end as pc,
  (epoch_us(c.ts) - lo) * 5 // (hi - lo + 1) + case cast(substr(c.uid, 2) as bigint) % 5 when 1 then 1 when 2 then 2 else 0 end as ps
  from {conn} c cross join b left join {ssl} s on c.uid = s.uid),
 a as (select pc as part, t as us from r union all select ps, tls from r where tls is not null),
 m as (select p.part, coalesce((select max(us) from a where a.part < p.part) // 1000 - (select max(behind) from r), 0) as mark from (select distinct part from a) p)"""


@query(
    "j2_early_batches",
    _EARLY_PARTS
    + """ select uid, t as ts_us, proto, case when tls > mt.mark * 1000 and (pc = ps or (pc < ps and t // 1000 + 2000 > mt.mark) or (pc > ps and tls // 1000 + 120000 > mc.mark))
 then version end as ssl_version from r join m mc on mc.part = pc left join m mt on mt.part = ps where t > mc.mark * 1000) x""",
)
def j2_early_parts(spark, sf) -> DataFrame:
    """The early form over seven batches and a closing one: a TLS record still counts if it comes before the timer of its connection (2 s
    after it, by event time), a connection if it comes before its TLS record is given up (after the TTL); late ones are dropped."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    conn = view(spark, sf, "conn").select("uid", "ts", "proto")
    b = conn.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    span = b["high"] - b["low"] + 1
    kind = F.expr("cast(substr(uid, 2) as bigint) % 5")
    late = lambda one, two: F.when(kind == one, 1).when(kind == two, 2).otherwise(0)
    conn = conn.withColumn("part", F.floor((us - F.lit(b["low"])) * 5 / F.lit(span)))
    ssl = view(spark, sf, "ssl").select("uid", "ts", "version").join(conn.select("uid", "part"), "uid")
    rows = conn.withColumns({"log": F.lit("conn"), "part": F.col("part") + late(3, 4)})
    rows = rows.unionByName(ssl.withColumns({"log": F.lit("ssl"), "part": F.col("part") + late(1, 2)}), allowMissingColumns=True)
    rows = stored_table(rows, "arrivals")
    end = rows.filter("log = 'conn'").orderBy("uid").limit(1).withColumns({"uid": F.lit("C-1"), "ts": (F.timestamp_micros(F.lit(b["high"] + 2 * span)) + F.expr("interval 1 day")).cast(rows.schema["ts"].dataType)})

    def flows(stream: DataFrame) -> DataFrame:
        logs = {"conn": stream.filter("log = 'conn'").select("uid", "ts", "proto"), "ssl": stream.filter("log = 'ssl'").select("uid", "ts", "version")}
        return correlate_early(logs, Settings(early_lateness_seconds=span * 3 // 10_000_000))

    parts = [rows.filter(F.col("part") == k) for k in range(7)]
    found = drain_in_turn([p.drop("part") for p in [*parts, end]], flows, "early-batches")
    return found.filter("uid <> 'C-1'").select("uid", _us("ts"), "proto", "ssl_version")


@query("k6_stream_dedup", "select distinct uid, version from {ssl_dup}")
def k6_stream(spark, sf) -> DataFrame:
    stream = _stream_view(spark, _events_stream(spark, sf), "ssl_dup")
    return drain_to_table(dedup_stream(stream).select("uid", "version"), "dedup")


@query("w1_stream_new_fingerprints", "select distinct ja3 from {ssl} where ja3 is not null")
def w1_stream(spark, sf) -> DataFrame:
    stream = _stream_view(spark, _events_stream(spark, sf), "ssl").filter("ja3 is not null").select("ja3")
    return drain_to_table(new_fingerprints(stream), "new-fingerprints")


@query(
    "w5_stream_flow_windows",
    "select epoch_us(to_timestamp(floor(epoch_us(ts)/1e6/30)*30)) as window_start_us, id_orig_h as src_ip, count(*) as flows, cast(sum(orig_bytes) as bigint) as bytes_in from {conn} group by 1, 2",
)
def w5_stream(spark, sf) -> DataFrame:
    conn = _stream_view(spark, _events_stream(spark, sf, closing=True), "conn")
    rows = conn.select("ts", F.col("id_orig_h").alias("src_ip"), F.col("id_resp_h").alias("dst_ip"), F.col("orig_bytes").alias("bytes_in"), F.col("resp_bytes").alias("bytes_out"))
    done = drain_to_table(source_activity_stream(rows), "activity")
    return done.select(_us("window_start"), "src_ip", "flows", "bytes_in")


@query("a4_stream_flow_rate", "select epoch_us(to_timestamp(floor(epoch_us(ts)/1e6/60)*60)) as window_start_us, count(*) as flows from {conn} group by 1")
def a4_stream(spark, sf) -> DataFrame:
    conn = _stream_view(spark, _events_stream(spark, sf, closing=True), "conn")
    return drain_to_table(flow_rate_stream(conn.select("ts"), 60), "rate").select(_us("window_start"), "flows")


_LIVE = """
select uid, risk_score, case when risk_score >= 85 then 'critical' when risk_score >= 70 then 'high' when risk_score >= 65 then 'medium' else 'low' end as severity
from (select t.uid, case when t.tls_malicious then 100 else least(100,
 cast(floor((cast(0.475 as double) + cast(0.05 as double)*e.score)*100 + 1e-9) as integer) + cast(floor(t.tls_risk*30) as integer)) end as risk_score
 from {tls} t join {ewma_rows} r on r.uid = t.uid join {ewma_score} e on e.rn = r.rn) s"""


def run_live(spark, sf, detectors: DetectorSet | None = None) -> str:
    """Stream of flows through live scoring; returns where the tables are."""
    base = scratch_path(spark, "live")
    events = _events_stream(spark, sf)
    ssl = view(spark, sf, "ssl").withColumn("ts", F.col("ts").cast("timestamp"))
    flows = _stream_view(spark, events, "conn").join(
        ssl.select(*[F.col(c).alias(c if c == "uid" else f"ssl_{c}") for c in ssl.columns]), "uid", "left"
    )
    job = LiveScoring(f"{base}/out", threat_table(spark), detectors or DetectorSet())
    job.start(flows, f"{base}/progress", available_now=True).awaitTermination()
    return f"{base}/out"


@query("live_scoring", _LIVE)
def live(spark, sf) -> DataFrame:
    out = run_live(spark, sf)
    return spark.read.parquet(f"{out}/traffic").select("uid", "risk_score", "severity")


@query("live_alerts", f"select uid, severity from ({_LIVE}) t where risk_score >= 65")
def live_alerts(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{run_live(spark, sf)}/alerts").select("uid", "severity")


_CLOSING = 900_000_000_000_008  # id of a far-future event whose connection has packets enough not to be noise


@query(
    "live_end_to_end",
    "select uid, true as in_range, true as alert_rule from {conn} where coalesce(orig_pkts,0) + coalesce(resp_pkts,0) >= 3",
)
def live_all(spark, sf) -> DataFrame:
    """Four log streams in several batches, noise filter, correlation, four fitted detectors, alerts and traffic: complete,
    every risk in range, and an alert for exactly the flows at or above the threshold."""
    base, events = scratch_path(spark, "live-all"), view(spark, sf, "events")
    bounds = events.agg(F.expr("min(unix_micros(cast(ts as timestamp))) as low"), F.expr("max(unix_micros(cast(ts as timestamp))) as high")).first()
    us, third = F.unix_micros(F.col("ts").cast("timestamp")), (bounds["high"] - bounds["low"]) // 3 + 1
    last = events.agg(F.max("ts").alias("ts")).select(
        F.lit(_CLOSING).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("interval 10 days")).cast("timestamp_ntz").alias("ts"),
        F.lit(0).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    detectors = fit_detectors(inputs.netflow(spark, sf), order=("ts", "uid"))
    job = LiveScoring(f"{base}/out", threat_table(spark), detectors)
    for part in range(3):  # events arrive in the order of time, a third after the other
        rows = events.filter(F.floor((us - F.lit(bounds["low"])) / third) == part)
        (rows.unionByName(last) if part == 2 else rows).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        logs = {n: _stream_view(spark, stream, n) for n in ("conn", "ssl", "dns", "weird")}
        job.start(live_flows(logs), f"{base}/progress", available_now=True).awaitTermination()
    alerts = spark.read.parquet(f"{base}/out/alerts").select("uid", F.lit(True).alias("alerted")).distinct()
    flows = spark.read.parquet(f"{base}/out/traffic").filter(F.col("uid") != f"C{_CLOSING}").join(alerts, "uid", "left")
    return flows.select(
        "uid", F.col("risk_score").between(0, 100).alias("in_range"), ((F.col("risk_score") >= DEFAULTS.alert_threshold) == F.coalesce("alerted", F.lit(False))).alias("alert_rule")
    )


@query(
    "w7_ledger_resumed",
    _CHAIN.replace("@D", str(_DAY_US)),
)
def w7_resumed(spark, sf) -> DataFrame:
    """The ledger built in two runs, the second starting from the blocks the first left open."""
    events = materialise(blocking_events(inputs.scored(spark, sf)))
    middle = events.agg(F.expr("cast((min(unix_micros(cast(ts as timestamp))) + max(unix_micros(cast(ts as timestamp)))) / 2 as bigint)")).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle)
    settings = Settings(block_seconds=86400)
    first = materialise(block_ledger(events.filter(early), None, settings))
    second = block_ledger(events.filter(~early), None, settings, open_blocks=first.filter(F.col("end_us") > middle))
    return first.unionByName(second.filter(~F.col("carried"))).drop("carried")


def arrivals(rows: DataFrame, parts: int, late_seconds: int) -> list[DataFrame]:
    """A table in parts by time, as it would arrive: of the rows of a part's last ``late_seconds`` every seventh comes with the next."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    width = ((bounds["high"] or 0) - (bounds["low"] or 0)) // parts + 1
    at = us - F.lit(bounds["low"] or 0)
    late = (F.pmod(F.xxhash64("uid"), F.lit(7)) == 0) & (at % width >= width - late_seconds * 1_000_000)
    part = F.least(F.floor(at / width) + late.cast("int"), F.lit(parts - 1))
    return [rows.filter(part == k) for k in range(parts)]


@query("w7_stream_ledger", _MANUAL.replace("@D", str(_DAY_US)))
def w7_stream(spark, sf) -> DataFrame:
    """Alerts and manual actions arrive in five parts, some of them late; the ledger is keyed state with a timer per address."""
    alerts = blocking_events(inputs.scored(spark, sf)).withColumn("action", F.lit(None).cast("string"))
    acts = view(spark, sf, "actions").select("ip", F.col("ts"), F.concat(F.lit("manual-"), "ip").alias("uid"), F.lit(None).cast("int").alias("score"), "action")
    rows = materialise(alerts.select("ip", F.col("ts").cast("timestamp").alias("ts"), "uid", F.col("score").cast("int").alias("score"), "action").unionByName(acts.withColumn("ts", F.col("ts").cast("timestamp"))))
    # an event of no address, so late that all blocks are over
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit("").alias("ip"), (F.col("ts") + F.expr("interval 10 days")).alias("ts"), F.lit("").alias("uid"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("action"))
    *parts, last = arrivals(rows, 5, 36_000)

    def ledger(stream: DataFrame) -> DataFrame:
        events = stream.filter("action is null").select("ip", "ts", "uid", "score")
        return ledger_stream(events, stream.filter("action is not null").select("ip", "ts", "action"), Settings(block_seconds=86400), delay_seconds=86_400)

    return drain_in_turn([*parts, last.unionByName(end)], ledger, "stream-ledger").filter("ip <> ''")


@query("w1_stream_sightings", "select ja3, uid, tls_malicious as malicious, not tls_malicious as is_new from {tls} where first_seen and ja3 is not null")
def w1_sightings(spark, sf) -> DataFrame:
    """First sightings as keyed state, over flows that arrive in five parts, some of them late."""
    rows = materialise(inputs.analysed(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "uid", "ja3", "tls_malicious"))
    return first_sightings_known(drain_changes(arrivals(rows, 5, 36_000), first_sighting_state, "sightings"))


@query("stat_stream_carry", "select n.uid, round(s.score, 6) as statistical_score from {ewma_rows} n join {ewma_score} s on n.rn = s.rn")
def stat_carry(spark, sf) -> DataFrame:
    """Two runs in event order, the second starting from the saved baseline of the first."""
    rows = materialise(inputs.features(spark, sf))
    middle = rows.agg(F.expr("cast((min(unix_micros(cast(ts as timestamp))) + max(unix_micros(cast(ts as timestamp)))) / 2 as bigint)")).first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(middle)
    path = scratch_path(spark, "baseline")
    one, state = EwmaBaseline().score(ordered_blocks(rows.filter(early)))
    state.save(spark, path)
    two, _ = EwmaBaseline().score(ordered_blocks(rows.filter(~early)), EwmaState.load(spark, path))
    both = one.unionByName(two)
    return both.select("uid", F.round("statistical_score", 6).alias("statistical_score"))


# ---- running reports: five batches, one of them taken twice, merged on the way


def _running(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """A report over rows that arrive in five parts. ``make``: from a way to read what has arrived to the report."""
    base, rows = scratch_path(spark, "running"), materialise(rows)
    arrived = lambda: spark.read.schema(rows.schema).parquet(f"{base}/in")
    job = running.Running(f"{base}/out", {"report": make(arrived)}, compact_every=2)
    for number, part in enumerate(arrivals(rows, 5, 36_000)):
        part.write.mode("append").parquet(f"{base}/in")
        job.start(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/progress", available_now=True).awaitTermination()
        if number == 3:
            job.take(part, number)
    return job.read(spark, "report")


def _timed_traffic(spark, sf) -> DataFrame:
    return inputs.traffic(spark, sf).withColumn("ts", F.expr("timestamp_seconds(timestamp)"))


def _printed(spark, sf) -> DataFrame:
    return inputs.fingerprints(spark, sf).select("uid", F.col("ts").cast("timestamp").alias("ts"), "ja3")


@query("a1_running", QUERIES["a1_traffic_totals"].oracle)
def a1_running(spark, sf) -> DataFrame:
    return _running(spark, _timed_traffic(spark, sf), lambda _: running.traffic_totals())


@query("a4_running", QUERIES["a4_flow_rate"].oracle)
def a4_running(spark, sf) -> DataFrame:
    return _running(spark, _timed_traffic(spark, sf), lambda _: running.flow_rate(60))


@query("a5_running", QUERIES["a5_fingerprint_stats"].oracle)
def a5_running(spark, sf) -> DataFrame:
    return _running(spark, _printed(spark, sf), lambda _: running.fingerprint_stats(threat_table(spark)))


@query("k1_running", QUERIES["k1_recent_alerts"].oracle)
def k1_running(spark, sf) -> DataFrame:
    alerts = inputs.fired(spark, sf).select("uid", F.col("ts").cast("timestamp").alias("ts"), "severity", "risk_score").withColumn("timestamp", F.col("ts"))
    return _running(spark, alerts, lambda _: running.recent_alerts(severity="high")).select("uid", "severity", "risk_score")


@query("k2_running", QUERIES["k2_recent_flows"].oracle)
def k2_running(spark, sf) -> DataFrame:
    return _running(spark, _timed_traffic(spark, sf), lambda _: running.recent_flows()).select("uid", "timestamp", "bytes_in")


@query("k3_running", QUERIES["k3_top_fingerprints"].oracle)
def k3_running(spark, sf) -> DataFrame:
    return _running(spark, _printed(spark, sf), lambda arrived: running.frequent_fingerprints(arrived))
