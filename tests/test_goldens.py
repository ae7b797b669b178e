"""Values worked out by hand."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import tls, wording
from tidewatch.functions.fixed_values import FEATURE_NAMES, NO_TLS_FINGERPRINT
from tidewatch.functions.flow_features import with_features
from tidewatch.functions.history import retransmissions, tcp_flags
from tidewatch.functions.numeric import finite
from tidewatch.operators.intel import blocklist_hashes, threat_table
from tidewatch.operators.risk import with_risk
from tidewatch.operators.tls_analysis import analyse_tls, with_fingerprint


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "history,both,client,server",
    [("ShADadFf", 27, 27, 25), ("S", 2, 2, 0), ("ShR", 6, 6, 0), ("Dd", 8, 8, 8), ("U^p", 40, 32, 8), (None, 0, 0, 0)],
)
def test_flags(spark, history, both, client, server):
    h = F.col("h")
    got = [one(spark, tcp_flags(h, s), h=history) for s in ("both", "client", "server")]
    assert got == [both, client, server]


def test_retransmissions(spark):
    assert one(spark, retransmissions(F.col("h")), h="ShADadtTcCF") == 4
    assert one(spark, retransmissions(F.col("h")), h=None) == 0


@pytest.mark.parametrize("text,value", [("1.5", 1.5), ("nan", 0.0), ("inf", 0.0), ("-", 0.0), (None, 0.0), ("-3", -3.0)])
def test_finite(spark, text, value):
    assert one(spark, finite(F.col("v")), v=text) == value


def test_ja3(spark):
    text = "769,47-53-5-10-49161-49162-49171-49172-50-56-19-4,0-10-11,23-24-25,0"
    parts = [F.lit(p) for p in text.split(",")]
    assert one(spark, tls.ja3_hash(*parts)) == hashlib.md5(text.encode()).hexdigest() == "ada70206e40642a3e4461f35503241d5"
    assert one(spark, tls.ja3s_hash(F.lit("769"), F.lit(None).cast("string"), F.lit("1"))) == hashlib.md5(b"769,,1").hexdigest()


@pytest.mark.parametrize("version,score", [("SSLv2", 1.0), ("TLSv1", 0.6), ("TLSv1.1", 0.4), ("TLSv13", 0.0), ("odd", 0.3), (None, None)])
def test_versions(spark, version, score):
    assert one(spark, tls.version_score(F.col("v")), v=version) == score


@pytest.mark.parametrize("cipher,weak", [("TLS_RSA_WITH_RC4_128_MD5", "RC4"), ("tls_dh_ANON_x", "anon"), ("X_3DES_Y", "DES"), ("TLS_AES_128_GCM_SHA256", None)])
def test_ciphers(spark, cipher, weak):
    assert one(spark, tls.weak_cipher(F.col("c")), c=cipher) == weak


@pytest.mark.parametrize(
    "name,risk",
    [
        ("www.example.com", 0.0), ("10.1.2.3", 0.3), ("256.1.2.3", 0.0), ("a.b.c.d.e.com", 0.25), ("promo.xyz", 0.2),
        ("x" * 51, 0.35), ("abcdefghijklmnopqrstu.com", 0.4), ("aaaaaaaaaaaaaaaaaaaaaaaaa.com", 0.0), (None, None),
    ],
)
def test_server_names(spark, name, risk):
    assert one(spark, tls.server_name_risk(F.col("n")), n=name) == risk


def test_entropy(spark):
    assert math.isclose(one(spark, tls.shannon_entropy(F.col("t")), t="aabbcd"), 1.9182958340544896)
    assert math.isclose(one(spark, tls.shannon_entropy(F.col("t")), t="AaBb"), 1.0)


@pytest.mark.parametrize("score,band", [(100, "critical"), (85, "critical"), (84, "high"), (70, "high"), (69, "medium"), (65, "medium"), (64, "low")])
def test_bands(spark, score, band):
    assert one(spark, wording.severity(F.lit(score))) == band


def test_threats(spark):
    rows = {r.ja3: r for r in threat_table(spark).collect()}
    assert len(set(blocklist_hashes())) == 99
    assert rows["51c64c77e60f3980eea90869b68c58a8"].malware == "CobaltStrike"
    assert rows["6734f37431670b3ab4292b8f60f29984"].malware == "TrickBot"
    assert rows["7a29c223fb122ec64d10f0a159e07996"].malware == "Custom Blocklist"


def scored(spark, rows):
    schema = "uid string, ts timestamp, ssl_version string, ssl_cipher string, ssl_server_name string, ssl_ja3 string, ssl_ja3s string"
    df = spark.createDataFrame(rows, schema)
    return {r.uid: r for r in with_risk(analyse_tls(df, threat_table(spark))).collect()}


def test_boosts(spark):
    """Untrained detectors give 47; each kind of evidence adds its points."""
    from datetime import datetime

    at = datetime(2024, 1, 1)
    seen = "f" * 32
    rows = [("a-first", at, None, None, None, seen, None)]
    late = datetime(2024, 1, 2)
    cases = {"SSLv2": 21, "SSLv3": 18, "TLSv10": 12, "TLSv11": 8, "TLSv12": 0, "odd": 0}
    rows += [(v, late, v, None, None, seen, None) for v in cases]
    rows += [("cipher", late, None, "RC4", None, seen, None), ("ip", late, None, None, "1.2.3.4", seen, None)]
    rows += [("bad", late, None, None, None, "b386946a5a44d1ddcc843bc75336dfce", None)]
    rows += [("server", late, None, None, None, "-", "e7d705a3286e19ea42f587b344ee6865")]
    got = scored(spark, rows)
    assert {v: got[v].risk_score for v in cases} == {v: 47 + p for v, p in cases.items()}
    assert got["a-first"].risk_score == 47 + 4 and got["a-first"].first_seen
    assert got["cipher"].risk_score == 47 + 15 and got["ip"].risk_score == 47 + 9
    assert got["bad"].risk_score == 100 and got["bad"].tls_risk_factors == ["JA3 matches known malware: Dridex"]
    assert got["server"].risk_score == 100 and got["server"].tls_threat == "Unknown TLS Client + Emotet (server)"
    assert got["server"].ja3 == NO_TLS_FINGERPRINT


def test_features_of_one_flow(spark):
    row = ("tcp", "ssl", 0, 1000, 10, 600, 500, 5, 2.0, "ShADadFft")
    schema = "proto string, service string, orig_ip_bytes bigint, orig_bytes bigint, orig_pkts bigint, resp_ip_bytes bigint, resp_bytes bigint, resp_pkts bigint, duration double, history string"
    r = with_features(spark.createDataFrame([row], schema)).first().asDict()
    expected = dict.fromkeys(FEATURE_NAMES, 0.0) | {
        "PROTOCOL": 6.0, "L7_PROTO": 91.0, "IN_BYTES": 1000.0, "IN_PKTS": 10.0, "OUT_BYTES": 600.0, "OUT_PKTS": 5.0,
        "TCP_FLAGS": 27.0, "CLIENT_TCP_FLAGS": 27.0, "SERVER_TCP_FLAGS": 25.0, "FLOW_DURATION_MILLISECONDS": 2000.0,
        "DURATION_IN": 1000.0, "DURATION_OUT": 1000.0, "MIN_TTL": 64.0, "MAX_TTL": 64.0, "LONGEST_FLOW_PKT": 180.0,
        "SHORTEST_FLOW_PKT": 40.0, "MIN_IP_PKT_LEN": 40.0, "MAX_IP_PKT_LEN": 180.0, "SRC_TO_DST_SECOND_BYTES": 500.0,
        "DST_TO_SRC_SECOND_BYTES": 300.0, "RETRANSMITTED_IN_PKTS": 1.0, "RETRANSMITTED_OUT_PKTS": 1.0,
        "SRC_TO_DST_AVG_THROUGHPUT": 4000.0, "DST_TO_SRC_AVG_THROUGHPUT": 2400.0, "NUM_PKTS_UP_TO_128_BYTES": 15.0,
    }
    assert {k: r[k] for k in FEATURE_NAMES} == expected


def test_absent_fields_are_missing(spark):
    df = spark.createDataFrame([("u",)], "uid string")
    assert {r for r in with_features(df).select(*FEATURE_NAMES).first()} == {0.0}
    r = with_fingerprint(df).first()
    assert r.ja3 == NO_TLS_FINGERPRINT and not r.has_tls and r.ja3s is None


def test_443_rule_is_off_by_default(spark):
    from datetime import datetime

    from tidewatch.config import Settings

    df = spark.createDataFrame([("u", datetime(2024, 1, 1), 443, None)], "uid string, ts timestamp, id_resp_p int, service string")
    on = analyse_tls(df, threat_table(spark), Settings(flag_443_without_tls=True)).first()
    off = analyse_tls(df, threat_table(spark)).first()
    assert on.tls_risk == 0.4 and off.tls_risk == 0.15 and len(on.tls_risk_factors) == 2


def test_netflow_identities(spark):
    from tidewatch.operators.risk import identities

    row = ("9.9.9.9", "", 0, 443, 6.0, "1.1.1.1", "2.2.2.2", 1000, "udp")
    schema = "IPV4_SRC_ADDR string, IPV4_DST_ADDR string, L4_SRC_PORT int, L4_DST_PORT int, PROTOCOL double, id_orig_h string, id_resp_h string, id_orig_p int, proto string"
    df = spark.createDataFrame([row], schema)
    got = df.select(*[c.alias(k) for k, c in identities(df).items()]).first()
    assert tuple(got) == ("9.9.9.9", "2.2.2.2", 1000, 443, "6")


def test_logs_are_read_by_their_own_headers(spark, tmp_path):
    from tidewatch.sources.logs import read_conn_log, stream_log

    folder = tmp_path / "conn"
    folder.mkdir()
    (folder / "a.log").write_text("#separator x\n#fields\tts\tuid\tid.orig_h\tproto\n1704067200.5\tC1\t10.0.0.1\ttcp\n#close\n")
    (folder / "b.log").write_text("#fields\tuid\tsite\tts\tproto\tid.orig_h\nC2\tb\t1704067201.25\tudp\t-\n")
    expected = {("C1", 1704067200500000, "10.0.0.1", "tcp"), ("C2", 1704067201250000, None, "udp")}
    columns = ["uid", "unix_micros(ts) as ts_us", "id_orig_h", "proto"]
    assert {tuple(r) for r in read_conn_log(spark, str(folder)).selectExpr(*columns).collect()} == expected
    stream = stream_log(spark, str(folder), "conn").selectExpr(*columns)
    query = stream.writeStream.format("memory").queryName("by_header").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("by_header").collect()} == expected


def test_a_log_without_header_raises(spark, tmp_path):
    import pytest

    from tidewatch.sources.logs import read_conn_log

    (tmp_path / "a.log").write_text("#fields\tts\tuid\n1\tC1\n")
    (tmp_path / "b.log").write_text("1\tC2\n")
    with pytest.raises(ValueError, match="no #fields line"):
        read_conn_log(spark, str(tmp_path))


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from tidewatch.sources.storage import shared_dir

    class Away:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Away())


def test_late_alert_gives_no_overlapping_block(spark):
    from tidewatch.operators.ledger import block_ledger

    at = lambda s: f"timestamp_seconds({s})"
    first = block_ledger(spark.sql(f"select '1.1.1.1' as ip, {at(1000)} as ts, 'C1' as uid, 80 as score"))
    late = spark.sql(f"select * from values ('1.1.1.1', {at(500)}, 'C0', 90), ('1.1.1.1', {at(2900)}, 'C2', 90) as t(ip, ts, uid, score)")
    second = block_ledger(late, open_blocks=first)
    rows = {(r.start_us, r.end_us, r.carried) for r in second.collect()}
    assert rows == {(1_000_000_000, 2_800_000_000, True), (2_900_000_000, 4_700_000_000, False)}
