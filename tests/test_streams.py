"""Streams agree with their batch forms, over several micro-batches and across restarts."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.views import view
from tidewatch.config import Settings
from tidewatch.detectors.ensemble import DetectorSet
from tidewatch.detectors.ewma import EwmaBaseline
from tidewatch.operators.correlate import correlate
from tidewatch.operators.intel import threat_table
from tidewatch.operators.ledger import block_ledger, blocking_events
from tidewatch.functions.flow_features import with_features
from tidewatch.operators.ordered import ordered_blocks
from tidewatch.plans.replay import score_flows
from tidewatch.sources.logs import read_conn_log, stream_log, write_text_log
from tidewatch.streaming.correlate import correlate_early, correlate_stream
from tidewatch.streaming import running
from tidewatch.streaming.live import LiveScoring
from tidewatch.streaming.run import drain_to_table

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "uid string, ts timestamp, v string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def put(spark, path, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def two_logs(spark, tmp_path):
    for n in ("conn", "ssl"):
        (tmp_path / n).mkdir(exist_ok=True)
    return {n: spark.readStream.schema(LOG).parquet(str(tmp_path / n)) for n in ("conn", "ssl")}


def test_sessions_over_batches(spark, tmp_path):
    logs = two_logs(spark, tmp_path)
    put(spark, tmp_path / "conn", [("a", at(0), "a1"), ("b", at(5), "b1")])
    put(spark, tmp_path / "ssl", [("a", at(1), "x"), ("orphan", at(2), "o")])
    run = lambda: drain_to_table(correlate_stream(logs), "s", str(tmp_path / "out"))
    assert run().count() == 0
    put(spark, tmp_path / "conn", [("c", at(200), "c1")])
    put(spark, tmp_path / "ssl", [("a", at(60), "y")])
    run()
    put(spark, tmp_path / "conn", [("z", at(5000), "z1")])
    put(spark, tmp_path / "ssl", [("z", at(5000), "z2")])
    got = {(r.uid, r.v, r.ssl_v) for r in run().collect()}
    assert got == {("a", "a1", "y"), ("b", "b1", None), ("c", "c1", None)}


def test_session_gap_is_the_same_in_batch_and_stream(spark, tmp_path):
    """At exactly the TTL and one microsecond more."""
    tick = timedelta(microseconds=1)
    conn = [("on", at(0), "c"), ("off", at(0), "c"), ("end", at(9000), "c")]
    ssl = [("on", at(120), "s"), ("off", at(120) + tick, "s"), ("end", at(9000), "s")]
    put(spark, tmp_path / "conn", conn)
    put(spark, tmp_path / "ssl", ssl)
    batch = correlate({n: spark.read.schema(LOG).parquet(str(tmp_path / n)) for n in ("conn", "ssl")})
    stream = drain_to_table(correlate_stream(two_logs(spark, tmp_path)), "s")
    rows = [{(r.uid, r.ssl_v) for r in df.filter("uid <> 'end'").collect()} for df in (batch, stream)]
    assert rows[0] == rows[1] == {("on", "s"), ("off", None)}


def test_early_form(spark, tmp_path):
    logs = two_logs(spark, tmp_path)
    out = str(tmp_path / "out")
    run = lambda: {(r.uid, r.v, r.ssl_v) for r in drain_to_table(correlate_early(logs), "e", out).collect()}
    put(spark, tmp_path / "conn", [("both", at(0), "b"), ("alone", at(1), "a")])
    put(spark, tmp_path / "ssl", [("both", at(1), "s"), ("orphan", at(2), "o")])
    assert run() == {("both", "b", "s")}
    put(spark, tmp_path / "conn", [("next", at(400), "n")])
    put(spark, tmp_path / "ssl", [("next", at(400), "n")])
    assert run() == {("both", "b", "s"), ("next", "n", "n"), ("alone", "a", None)}


def test_early_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    """Many uids in few state values; those that are due come out, the others wait, and a late TLS record finds its connection."""
    from tidewatch.streaming import correlate as module

    monkeypatch.setattr(module, "_BUCKETS", 3)
    logs, out = two_logs(spark, tmp_path), str(tmp_path / "out")
    run = lambda: {(r.uid, r.v, r.ssl_v) for r in drain_to_table(correlate_early(logs), "e", out).collect()}
    put(spark, tmp_path / "conn", [(f"u{k}", at(k), f"c{k}") for k in range(40)])
    put(spark, tmp_path / "ssl", [(f"u{k}", at(k), f"s{k}") for k in range(0, 30, 3)] + [("orphan", at(30), "o")])
    closed = {(f"u{k}", f"c{k}", None if k % 3 or k >= 30 else f"s{k}") for k in range(36)}  # the watermark is at 37 s: due at or before it
    assert run() == closed
    state = spark.read.format("statestore").option("stateVarName", "bucket").load(f"{out}/progress").selectExpr("explode(value.entries) as e", "key")
    assert {r["uid"] for r in state.select("e.uid").collect()} == {"u36", "u37", "u38", "u39", "orphan"}
    assert state.select("key").distinct().count() <= 3
    put(spark, tmp_path / "conn", [("end", at(4000), "z")])
    put(spark, tmp_path / "ssl", [("u38", at(38), "late"), ("end", at(4000), "z")])
    assert run() - closed == {("u36", "c36", None), ("u37", "c37", None), ("u38", "c38", "late"), ("u39", "c39", None), ("end", "z", "z")}


def test_flow_window_state_is_small(spark, tmp_path):
    """A window of few destinations doesn't hold a table of registers; few destinations are counted exactly."""
    from tidewatch.streaming.reports import source_activity_stream

    schema, out = "ts timestamp, src_ip string, dst_ip string, bytes_in bigint, bytes_out bigint", str(tmp_path / "out")
    rows = [(at(30 * w), f"s{w}", None if w == 0 else f"d{k % w}", 1, 2) for w in range(9) for k in range(12)]
    put(spark, tmp_path / "in", [*rows, (at(5000), "end", "d", 0, 0)], schema)
    found = drain_to_table(source_activity_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "w", out)
    assert {(r.src_ip, r.flows, r.distinct_destinations) for r in found.collect()} == {(f"s{w}", 12, w) for w in range(9)}
    put(spark, tmp_path / "in", [(at(5000 + w), f"s{w}", "d", 1, 1) for w in range(50)], schema)
    drain_to_table(source_activity_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "w", out)
    state = [r["value"] for r in spark.read.format("statestore").load(f"{out}/progress").collect()]
    assert state and max(len(v) for v in state) < 10
    assert max(len(x) for v in state for x in v if isinstance(x, (bytes, bytearray))) < 100


def test_log_folder_that_starts_empty(spark, tmp_path):
    folder = tmp_path / "conn-log"
    folder.mkdir()
    rows = spark.createDataFrame([("a", at(0.25), "tcp")], "uid string, ts timestamp, proto string")
    stream = stream_log(spark, str(folder), "conn", fields=["uid", "ts", "proto"])
    assert drain_to_table(stream, "l", str(tmp_path / "out")).count() == 0
    write_text_log(rows, str(folder / "one"), "conn")
    for part in list((folder / "one").glob("part-*")):
        (folder / part.name).write_bytes(part.read_bytes())
    got = drain_to_table(stream, "l", str(tmp_path / "out")).filter("uid is not null").collect()
    assert [(r.uid, r.ts.timestamp(), r.proto) for r in got] == [("a", at(0.25).timestamp(), "tcp")]


def test_text_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", at(1), "", None, 0.5), ("b", None, "h", 443, None)], "uid string, ts timestamp, id_orig_h string, id_orig_p int, duration double")
    write_text_log(rows, str(tmp_path / "log"), "conn")
    got = read_conn_log(spark, str(tmp_path / "log")).select(*rows.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


@pytest.fixture(scope="module")
def small_flows(spark, sf):
    flows = inputs.flows(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.withColumn("ssl_ts", F.col("ssl_ts").cast("timestamp"))


def test_live_scoring_in_three_batches_equals_one_pass(spark, sf, small_flows, tmp_path):
    """Baseline, first sightings and open blocks carry over; a batch run twice changes nothing."""
    settings = Settings(block_seconds=5 * 86400)
    threats = threat_table(spark)
    actions = view(spark, sf, "actions").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = [r[0] for r in small_flows.selectExpr("percentile_approx(ts, array(0.3, 0.7))").collect()][0]
    parts = [small_flows.filter(F.col("ts") < bounds[0]), small_flows.filter((F.col("ts") >= bounds[0]) & (F.col("ts") < bounds[1])), small_flows.filter(F.col("ts") >= bounds[1])]
    job = LiveScoring(str(tmp_path / "live"), threats, DetectorSet(settings=settings), settings, actions)
    for number, part in enumerate(parts):
        job.process(part, number)
        if number == 1:
            job.process(part, number)
    live = {r.uid: r.risk_score for r in spark.read.parquet(str(tmp_path / "live/traffic")).collect()}

    scored, _ = EwmaBaseline().score(ordered_blocks(with_features(small_flows)))
    whole = score_flows(scored.drop("_block", "_row"), threats, settings)
    assert live == {r.uid: r.risk_score for r in whole.select("uid", "risk_score").collect()}

    expected = {(r.ip, r.start_us, r.end_us, r.ended_by) for r in block_ledger(blocking_events(whole), actions, settings).collect()}
    newest = F.max_by(F.struct("ip", "start_us", "end_us", "ended_by"), "batch").alias("r")
    rows = spark.read.parquet(str(tmp_path / "live/ledger")).groupBy(F.col("ip").alias("k"), F.col("start_us").alias("s")).agg(newest)
    assert {tuple(r.r) for r in rows.collect()} == expected


def test_empty_batch_keeps_the_state(spark, small_flows, tmp_path):
    job = LiveScoring(str(tmp_path / "live"), threat_table(spark), DetectorSet())
    job.process(small_flows.limit(0), 0)
    job.process(small_flows, 1)
    job.process(small_flows.limit(0), 2)
    n = [spark.read.parquet(str(tmp_path / f"live/baseline/batch={b}")).first()["n"] for b in (0, 1, 2)]
    assert n == [0, small_flows.count(), small_flows.count()]


def test_live_scoring_leaves_no_scratch(spark, sf):
    import glob

    from tidewatch.catalog.jobs import run_live
    from tidewatch.sources.storage import shared_dir

    folder = shared_dir(spark).replace("file:", "")

    def scratch():
        return {*glob.glob(f"{folder}/unordered-*"), *glob.glob(f"{folder}/scored-*")}

    before = scratch()  # of other operators
    run_live(spark, sf)
    assert scratch() == before


def _brute_top(rows, n):
    counts = {}
    for ja3, ts, uid in rows:
        if ja3 is not None:
            hits, first = counts.get(ja3, (0, (ts, uid)))
            counts[ja3] = hits + 1, min(first, (ts, uid))
    order = sorted(counts, key=lambda j: (-counts[j][0], counts[j][1], j))[:n]
    return [(j, counts[j][0]) for j in order]


@pytest.mark.parametrize("kept, flat", [(2, False), (6, True), (50, False)])
def test_counter_summary_is_exact_whatever_it_keeps(spark, tmp_path, kept, flat):
    """Few counters, many, and so many that none goes; one fingerprint with a third of all rows, or all alike and in other batches."""
    import random

    draw = random.Random(kept)
    batches, seen = [], []
    for b in range(7):
        names = [f"f{draw.randrange(30)}" if flat or draw.random() > 0.6 else draw.choice(["hot", "warm", None]) for _ in range(80)]
        batches.append([(j, at(draw.randrange(500)), f"u{b}-{k}") for k, j in enumerate(names)])
    batches[4] = []
    frame = lambda rows: spark.createDataFrame(rows, "ja3 string, ts timestamp, uid string")
    job = running.Running(str(tmp_path / "r"), {"top": running.frequent_fingerprints(lambda: frame(seen), 5, kept)}, compact_every=2)
    for number, rows in enumerate(batches):
        seen += rows
        job.take(frame(rows), number)
        if number == 3:
            job.take(frame(rows), number)  # run again
        if number in (1, 6):
            assert [tuple(r) for r in job.read(spark, "top").collect()] == _brute_top(seen, 5)


def test_sketched_count_stays_within_its_error_and_batches_don_t_pile_up(spark, tmp_path):
    import os

    reports = {"about": running.fingerprint_stats_approximate(12), "protocols": running.protocol_breakdown(), "alerts": running.alerts_total()}
    job = running.Running(str(tmp_path / "r"), reports, compact_every=3)
    with pytest.raises(ValueError):
        job.read(spark, "about")
    wide = ["concat('f', id) as ja3", "if(id % 3 = 0, 'udp', 'tcp') as proto", "'DoS' as attack_type", "cast(id % 100 as int) as risk_score"]
    for b in range(10):  # neighbouring batches share half of their fingerprints
        job.take(spark.range(b * 5000, b * 5000 + 10_000).selectExpr(*wide), b)
    found = job.read(spark, "about").first()
    assert found["total_fingerprinted"] == 100_000
    assert abs(found["unique_ja3_count"] - 55_000) < 4 * 1.04 / 64 * 55_000
    protocols = {r["proto"]: r["flows"] for r in job.read(spark, "protocols").collect()}
    assert sum(protocols.values()) == 100_000 and protocols["udp"] == sum(len(range(-b * 5000 % 3, 10_000, 3)) for b in range(10))
    assert job.read(spark, "alerts").first()["alerts_total"] == 80_000
    assert len([f for f in os.listdir(tmp_path / "r/about") if "=" in f]) <= 3 + 3 + 2


def test_batch_cut_off_while_it_was_written_does_not_count(spark, tmp_path):
    import os

    job = running.Running(str(tmp_path / "r"), {"protocols": running.protocol_breakdown()})
    rows = spark.createDataFrame([("tcp",), (None,)], "proto string")
    job.take(rows, 0), job.take(rows, 1)
    os.remove(tmp_path / "r/protocols/batch=1/_SUCCESS")
    count = lambda: {r["proto"]: r["flows"] for r in job.read(spark, "protocols").collect()}
    assert count() == {"tcp": 1, None: 1}
    job.take(rows, 1)
    assert count() == {"tcp": 2, None: 2}


def test_stream_ledger_shares_states_between_addresses(spark, tmp_path):
    """Addresses by the hundred, some unblocked: as in batch, and no more states than buckets."""
    from tidewatch.streaming.ledger import ledger_stream

    rows = [(f"ip{k % 300}", 1_000_000 + 7 * k * 1_000_000, f"C{k}", k % 90, None) for k in range(3000)]
    rows += [(f"ip{k % 300}", 2_000_000 + 70 * k * 1_000_000, "", None, "unblock" if k % 3 else "block") for k in range(200)]
    rows += [(None, 5_000_000, "nobody", 1, None)]
    held = spark.createDataFrame(rows, "ip string, us bigint, uid string, score int, action string").select("ip", F.timestamp_micros("us").alias("ts"), "uid", "score", "action")
    last = spark.createDataFrame([("end", 10**12)], "ip string, us bigint").select("ip", F.timestamp_micros("us").alias("ts"), F.lit("").alias("uid"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("action"))
    settings = Settings(block_seconds=900)
    alerts = lambda df: df.filter("action is null").select("ip", "ts", "uid", "score")
    acts = lambda df: df.filter("action is not null").select("ip", "ts", "action")
    states = []
    for number, part in enumerate([held, last]):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(held.schema).parquet(str(tmp_path / "in"))
        out = ledger_stream(alerts(stream), acts(stream), settings, delay_seconds=60, buckets=4)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(states) <= 4
    columns = ["ip", "start_us", "expiry_us", "end_us", "score", "source", "ended_by"]
    got = spark.read.parquet(str(tmp_path / "out")).filter("ip <> 'end'").select(columns).collect()
    expected = block_ledger(alerts(held), acts(held), settings).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len({r.ip for r in got}) == 300


def test_stream_ledger_settles_addresses_whose_times_are_far_apart():
    import pandas as pd

    from tidewatch.streaming.ledger import _settle

    rows = pd.DataFrame([(f"ip{k}", t, 9, 0) for k in range(20) for t in (k, k + 5, k + 2**58)], columns=["ip", "t", "score", "kind"])
    done, still = _settle(rows, rows.iloc[:0], 10, 2**58 + 25)
    assert sorted(zip(done["ip"], done["start_us"])) == sorted([(f"ip{k}", k) for k in range(20)] + [(f"ip{k}", k + 2**58) for k in range(16)])
    assert sorted(still["t"]) == [k + 2**58 for k in range(16, 20)]


def test_live_detectors_see_each_flow_once_and_no_empty_batch(spark, sf, tmp_path):
    met, calls = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    class Counting(DetectorSet):
        def transform_ordered(self, ordered, start=None, lead=None):
            calls.append(1)
            scored, after, tail = super().transform_ordered(ordered, start, lead)
            return scored.mapInArrow(counted, scored.schema), after, tail

    flows = inputs.flows(spark, sf)
    job = LiveScoring(str(tmp_path / "live"), threat_table(spark), Counting())
    job.process(flows, 0)
    total = flows.count()
    assert met.value == total and len(calls) == 1
    table = lambda name, batch: spark.read.parquet(str(tmp_path / f"live/{name}/batch={batch}"))
    job.process(flows.limit(0), 1)
    assert len(calls) == 1
    for name in ("baseline", "open_blocks"):
        assert sorted(map(str, table(name, 1).collect())) == sorted(map(str, table(name, 0).collect()))
    job.process(flows, 2)
    assert len(calls) == 2 and table("baseline", 2).first()["n"] == 2 * total
    assert spark.read.parquet(str(tmp_path / "live/traffic")).count() == 2 * total
