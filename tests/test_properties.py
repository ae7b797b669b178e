"""Operators against brute force, for any partitioning and under skew."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.detectors.ewma import EwmaBaseline, EwmaState
from tidewatch.operators.correlate import correlate, join_conn_ssl
from tidewatch.operators.evaluation import calibration, calibration_error, ranking_quality
from tidewatch.operators.kpi import recent_alerts
from tidewatch.operators.ledger import block_ledger
from tidewatch.operators.ordered import ordered_blocks, sliding_windows
from tidewatch.operators.sampling import first_per_uid, sample_fraction
from tidewatch.operators.statistics import class_weights, exact_percentile
from tidewatch.operators.tls_analysis import with_fingerprint, with_first_seen

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# ---- EWMA


def sequential(x, alpha=0.05, limit=3.5, warmup=30):
    mean, var, n, scores = None, None, 0, []
    for row in x:
        if n < warmup:
            scores.append(0.0)
        else:
            z = np.abs(row - mean) / np.sqrt(var + 1e-8)
            scores.append(min(1.0, max(0.0, 0.6 * np.mean(z > limit) + 0.4 * min(1.0, np.max(z) / (3 * limit)))))
        if mean is None:
            mean, var = row.copy(), np.zeros_like(row)
        else:
            d = row - mean
            mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
        n += 1
    return scores, mean, var


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_ewma_equals_a_loop(spark, blocks):
    rng = np.random.default_rng(blocks)
    x = np.column_stack([rng.lognormal(3, 2, 700), np.full(700, 64.0), rng.integers(0, 3, 700) * 1e6])
    rows = [(f"u{i:04d}", at(i // 3), *map(float, r)) for i, r in enumerate(x)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "uid string, ts timestamp, a double, b double, c double")
    detector = EwmaBaseline(features=("a", "b", "c"))
    scored, end = detector.score(ordered_blocks(df, blocks=blocks))
    got = {r.uid: r.statistical_score for r in scored.collect()}
    expected, mean, var = sequential(x)
    assert np.allclose([got[f"u{i:04d}"] for i in range(700)], expected, rtol=0, atol=1e-9)
    assert np.allclose(end.mean, mean, rtol=1e-10) and np.allclose(end.var, var, rtol=1e-8, atol=1e-12) and end.n == 700


@pytest.mark.parametrize("blocks", [1, 13])
def test_every_entity_has_its_own_baseline_and_buffer(spark, blocks, monkeypatch):
    """One entity of a third of all rows, many short ones, one without a name; states composed three at a time over several levels."""
    from tidewatch.operators import ordered, scan

    monkeypatch.setattr(scan.carried, "__defaults__", (None, 3))
    monkeypatch.setattr(scan.outcome, "__defaults__", (None, 3))
    if blocks == 13:
        monkeypatch.setattr(ordered, "_BROADCAST_BLOCKS", 2)
    rng = np.random.default_rng(7)
    names = ["hot"] * 500 + ["warm"] * 80 + [None] * 45 + [f"e{i % 150}" for i in range(875)]
    rng.shuffle(names)
    x = np.column_stack([rng.lognormal(3, 2, 1500), rng.integers(0, 3, 1500) * 1e6])
    rows = [(f"u{i:04d}", at(i // 3), e, *map(float, r)) for i, (e, r) in enumerate(zip(names, x, strict=True))]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "uid string, ts timestamp, e string, a double, b double").repartition(5)
    ordered_rows = ordered_blocks(df, blocks=blocks, entity=("e",))
    assert len(ordered_rows.sizes) == blocks
    scored = {r.uid: r.statistical_score for r in EwmaBaseline(features=("a", "b")).score_entities(ordered_rows).collect()}
    held = {r.uid: r.buffered for r in ordered.entity_counts(ordered_rows).collect()}
    for entity in set(names):
        own = [i for i, e in enumerate(names) if e == entity]
        expected = sequential(x[own])[0]
        assert np.allclose([scored[f"u{i:04d}"] for i in own], expected, rtol=0, atol=1e-9)
        assert [held[f"u{i:04d}"] for i in own] == [min(k + 1, 10) for k in range(len(own))]


@pytest.mark.parametrize("blocks", [1, 13])
def test_scans_of_more_blocks_than_one_task_composes(spark, blocks, monkeypatch):
    """The same numbers whether states are composed at once or level by level, joined by broadcast or by a merge; a lead-in counts."""
    from tidewatch.operators import ordered, scan

    rng = np.random.default_rng(3)
    rows = [(f"u{i:03d}", at(i), float(v), float(v * v)) for i, v in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, a double, b double").repartition(4)
    detector, start = EwmaBaseline(features=("a", "b")), EwmaState(40, [1.0, 2.0], [0.5, 0.25])

    def run():
        own = ordered_blocks(df, blocks=blocks)
        scored, end = detector.score(own, start)
        tails = own.tails(own.tail_elements(9, ["a"]), 9, 1, [[7.0], [8.0]])
        before = {r["block"]: r["acc"] for r in tails[0].collect()}
        places = sorted((r["uid"], r["_position"]) for r in own.with_position().collect())
        return sorted((r.uid, round(r.statistical_score, 9)) for r in scored.collect()), np.round(end.mean + end.var, 9).tolist(), before, tails[1], places

    at_once = run()
    monkeypatch.setattr(scan.carried, "__defaults__", (None, 3))
    monkeypatch.setattr(scan.outcome, "__defaults__", (None, 3))
    monkeypatch.setattr(ordered, "_BROADCAST_BLOCKS", 0)
    assert run() == at_once
    values = [7.0, 8.0] + [r[2] for r in rows]
    assert at_once[3] == [[v] for v in values[-9:]] and at_once[2][0] == [7.0, 8.0]
    assert at_once[4] == [(f"u{i:03d}", i) for i in range(200)]


def test_copies_of_one_record_spread_over_blocks(spark):
    """A third of all rows being one and the same record does not end in one block."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("uid"), F.lit(at(0)).alias("ts"), F.lit(1.0).alias("a")
    )
    blocks = ordered_blocks(df, blocks=6)
    assert blocks.total == 3000 and len(blocks.sizes) == 6 and max(n for _, n in blocks.sizes) < 1500


def test_block_count():
    from tidewatch.operators.ordered import block_count

    assert block_count(1000, 8) == 8 and block_count(10**9, 8) == 101 and block_count(10**12, 200) == 100_001


# ---- windows


@pytest.mark.parametrize("blocks,bucket", [(1, 11), (5, 20), (9, 1000)])
def test_sliding_windows(spark, blocks, bucket):
    n = 120
    df = spark.createDataFrame([(f"u{i:03d}", at(i), float(i)) for i in range(n)], "uid string, ts timestamp, a double").repartition(7)
    got = {r["_position"]: [v[0] for v in r.window] for r in sliding_windows(ordered_blocks(df, blocks=blocks), 10, ["a"], bucket).collect()}
    assert got == {i: [float(v) for v in range(i - 9, i + 1)] for i in range(9, n)}


# ---- ledger


def ledger_by_hand(starts, unblocks, duration):
    events = sorted([(t, 0) for t in starts] + [(t, 2) for t in unblocks])
    out, current = [], None
    for t, kind in events:
        if current is not None and t >= current[1]:
            current = None
        if kind == 0 and current is None:
            current = [t, t + duration]
            out.append(current)
        elif kind == 2 and current is not None:
            current[1] = t
            current = None
    return sorted(tuple(x) for x in out)


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_ledger_equals_a_walk(spark, hot_rows):
    """Random alerts of two addresses, one of them dense, with and without thinning out."""
    rng = random.Random(7)
    dense = sorted({rng.randint(0, 400_000) for _ in range(6000)})  # milliseconds
    sparse = sorted({rng.randint(0, 400_000) for _ in range(8)})
    free = sorted({rng.randint(0, 400_000) for _ in range(12)})
    events = [("dense", at(t / 1000), f"d{t}", 80) for t in dense] + [("sparse", at(t / 1000), f"s{t}", 90) for t in sparse]
    actions = [(at(t / 1000), "dense", "unblock") for t in free]
    rows = block_ledger(
        spark.createDataFrame(events, "ip string, ts timestamp, uid string, score int"),
        spark.createDataFrame(actions, "ts timestamp, ip string, action string"),
        Settings(block_seconds=20),
        hot_rows=hot_rows,
    ).collect()
    base = int(T0.timestamp() * 1e6)
    for ip, starts, ends in (("dense", dense, free), ("sparse", sparse, [])):
        got = sorted(((r.start_us - base) // 1000, (r.end_us - base) // 1000) for r in rows if r.ip == ip)
        assert got == ledger_by_hand(starts, ends, 20_000)


def test_thinning_out_drops_most_rows(spark):
    from tidewatch.operators.ledger import thin_out

    starts = spark.range(0, 400_000).select(
        F.lit("hot").alias("ip"), (F.col("id") * 1000 + F.col("id") % 7).alias("t"), F.lit(0).alias("kind"), F.lit("").alias("uid"), F.lit(80).alias("score")
    )
    none = spark.createDataFrame([], "ip string, t bigint")
    kept = thin_out(starts, none, 20_000_000, 1_000_000).count()
    assert kept < 40_000


def test_block_boundary(spark):
    """At exactly the expiry a new block starts; just before, the alert is ignored."""
    events = [("a", at(0), "1", 80), ("a", at(1799.999), "2", 99), ("a", at(1800), "3", 77), ("b", at(5), "4", 75)]
    rows = block_ledger(spark.createDataFrame(events, "ip string, ts timestamp, uid string, score int")).collect()
    assert sorted((r.ip, r.score, r.ended_by) for r in rows) == [("a", 77, "expiry"), ("a", 80, "expiry"), ("b", 75, "expiry")]


# ---- correlation


def test_batch_join_multiplies(spark):
    conn = spark.createDataFrame([("a", 1), ("b", 2)], "uid string, n int")
    ssl = spark.createDataFrame([("a", "x"), ("a", "y")], "uid string, version string")
    rows = {(r.uid, r.ssl_version) for r in join_conn_ssl(conn, ssl).collect()}
    assert rows == {("a", "x"), ("a", "y"), ("b", None)}


def sessions_by_hand(records, ttl):
    out = []
    for uid in sorted({r[0] for r in records}):
        session = None
        for _, t, log, value in sorted(r for r in records if r[0] == uid):
            if session is None or t - session["last"] > ttl:
                session = {"uid": uid, "last": t}
                out.append(session)
            session["last"] = t
            session[log] = max(session.get(log, (-1, "")), (t, value))
    return sorted((s["uid"], s["conn"][1], s.get("ssl", (0, None))[1]) for s in out if "conn" in s)


def test_correlation_equals_a_walk(spark):
    rng = random.Random(3)
    records = [(rng.choice("abcdefgh"), rng.randint(0, 4000), rng.choice(["conn", "ssl"]), f"v{i:03d}") for i in range(250)]
    logs = {
        n: spark.createDataFrame([(u, at(t), v) for u, t, log, v in records if log == n], "uid string, ts timestamp, v string")
        for n in ("conn", "ssl")
    }
    got = sorted((r.uid, r.v, r.ssl_v) for r in correlate(logs).collect())
    assert got == sessions_by_hand(records, 120)


# ---- first sightings, dedup, statistics


def test_first_sighting_is_one_row_per_fingerprint(spark):
    rows = [(f"u{i}", at(100 - i), "hot" if i % 3 else f"f{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, ssl_ja3 string")
    marked = with_first_seen(with_fingerprint(df)).filter("first_seen")
    assert {r.ja3: r.uid for r in marked.collect()} == {"hot": "u59"} | {f"f{i}": f"u{i}" for i in range(0, 60, 3)}
    known = spark.createDataFrame([("hot",)], "ja3 string")
    assert with_first_seen(with_fingerprint(df), known).filter("first_seen and ja3 = 'hot'").count() == 0


def test_dedup_keeps_the_first(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 1, "w")]
    got = first_per_uid(spark.createDataFrame(rows, "uid string, n int, v string"), ["n"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "w"), ("b", 2, "z")]


@pytest.mark.parametrize("p", [0.0, 0.01, 0.37, 0.95, 1.0])
def test_exact_percentile(spark, p):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 3, 3000), np.full(1500, 2.5), [-1e9, 1e12]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert np.isclose(exact_percentile(df, "v", p, bins=16, small=50), np.percentile(values, p * 100), rtol=1e-12)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("uid"))
    one, many = (sorted(r.uid for r in sample_fraction(df.repartition(n), 0.1, 42).collect()) for n in (1, 13))
    assert one == many and 120 < len(one) < 280


def test_weights_balance(spark):
    df = spark.createDataFrame([("x",)] * 6 + [("y",)] * 2, "c string")
    assert {r.c: r.weight for r in class_weights(df, "c").collect()} == {"x": 8 / 12, "y": 2.0}


def test_severity_picks_from_the_feed(spark):
    """The feed holds the newest 200; an older alert of the asked severity stays out."""
    rows = [(f"u{i:03d}", float(i), "low") for i in range(1, 201)] + [("old", 0.0, "critical")]
    df = spark.createDataFrame(rows, "uid string, timestamp double, severity string")
    assert recent_alerts(df, severity="critical").count() == 0
    assert [r.uid for r in recent_alerts(df, limit=2).collect()] == ["u200", "u199"]


@pytest.mark.parametrize("distinct", [3, 100_000])
def test_ranking_quality_equals_comparing_all_pairs(spark, distinct):
    """One score with a third of all rows; missing labels and scores that are no number don't count."""
    draw = random.Random(distinct)
    rows = [(draw.random() < 0.3, 0.5 if draw.random() < 0.33 else draw.randrange(distinct) / distinct) for _ in range(400)]
    extra = [(None, 0.9), (True, float("nan")), (False, None)]
    df = spark.createDataFrame(rows + extra, "hit boolean, s double").withColumn("constant", F.lit(1.0)).repartition(5)
    found = {r["detector"]: r for r in ranking_quality(df, ["s", "constant"], "hit").collect()}
    pos, neg = [v for hit, v in rows if hit], [v for hit, v in rows if not hit]
    expected = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert found["s"]["auc"] == pytest.approx(expected, abs=1e-12) and (found["s"]["positives"], found["s"]["negatives"]) == (len(pos), len(neg))
    assert found["constant"]["auc"] == 0.5
    assert ranking_quality(df.filter("hit"), ["s"], "hit").first()["auc"] is None
    assert ranking_quality(df.filter("false"), ["s"], "hit").count() == 0


def test_calibration_error(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 0.95), (False, 0.95), (False, 0.05), (None, 0.5), (True, -2.0)], "hit boolean, s double")
    bins = calibration(df, ["s"], "hit")
    got = {r["bin"]: (r["rows"], round(r["mean_score"], 6), round(r["positive_share"], 6)) for r in bins.collect()}
    assert got == {9: (3, 0.966667, 0.666667), 0: (2, -0.975, 0.5)}
    assert calibration_error(bins).first()["calibration_error"] == pytest.approx((3 * 0.3 + 2 * 1.475) / 5)
