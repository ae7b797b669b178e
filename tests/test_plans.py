"""Plans: pushed filters, pruned columns, no Python and no all-pairs joins on the hot path."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import inputs, registered
from tidewatch.config import Settings
from tidewatch.functions.flow_features import with_features
from tidewatch.operators import kpi
from tidewatch.operators.correlate import correlate, join_conn_ssl
from tidewatch.operators.filters import drop_noise
from tidewatch.operators.intel import threat_table
from tidewatch.plans.replay import replay, replay_alerts
from tidewatch.sources.schemas import log_schema


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Empty parquet logs: plans do not depend on rows."""
    out = {}
    for name in ("conn", "ssl", "dns", "weird"):
        path = str(tmp_path_factory.mktemp("logs") / name)
        spark.createDataFrame([], log_schema(name)).write.parquet(path)
        out[name] = spark.read.schema(log_schema(name)).parquet(path)
    return out


def test_replay_plan(spark, logs):
    text = plan(replay_alerts(replay(logs["conn"], logs["ssl"], threat_table(spark))))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval|MapInPandas", text)
    for unused in ("missed_bytes", "conn_state", "cert_chain_fuids", "curve"):
        assert unused not in text


def test_features_are_one_stage(logs):
    text = plan(with_features(logs["conn"]))
    assert "Exchange" not in text and "Python" not in text


def test_compiled_code_stays_small(logs):
    """The JVM does not compile methods of more than 8000 bytes of bytecode."""
    df = with_features(logs["conn"])
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    sizes = [int(re.search(r"\((\d+),", str(stages.apply(i)._3())).group(1)) for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_noise_filter_is_pushed_before_the_join(logs):
    text = plan(join_conn_ssl(drop_noise(logs["conn"], 3).filter(F.col("proto") == "tcp"), logs["ssl"]).select("uid", "ssl_ja3"))
    assert "EqualTo(proto,tcp)" in text
    assert re.search(r"ReadSchema: struct<uid:string,ja3:string>", text)


def test_correlation_reduces_before_each_shuffle(logs):
    text = plan(correlate(logs))
    assert "CartesianProduct" not in text and "Join" not in text
    tree = text.split("\n\n")[0]
    assert len(re.findall(r"\n[ :+\-]*(?:\* )?Exchange", tree)) == 2


def test_reports_keep_top_rows_per_task(spark, sf):
    assert "TakeOrderedAndProject" in plan(kpi.top_fingerprints(inputs.fingerprints(spark, sf)))
    assert "TakeOrderedAndProject" in plan(kpi.recent_flows(inputs.traffic(spark, sf)))


def test_results_do_not_depend_on_partitions(spark, sf):
    query = registered()["r2_tls_risk"].build
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n, broadcast in ((1, "10MB"), (13, "-1")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        seen.append(sorted(map(tuple, query(spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert seen[0] == seen[1]


def test_settings_are_values():
    assert Settings(block_threshold=80).alert_threshold == 65
