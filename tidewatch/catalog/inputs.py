"""Shared Spark-side inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.views import VIEWS, view
from tidewatch.functions.flow_features import with_features
from tidewatch.functions.fixed_values import FEATURE_NAMES
from tidewatch.operators.correlate import join_conn_ssl
from tidewatch.operators.filters import alerts_only
from tidewatch.operators.intel import threat_table
from tidewatch.operators.risk import flow_records, with_risk
from tidewatch.operators.tls_analysis import analyse_tls, with_fingerprint
from tidewatch.sources.storage import spread


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return join_conn_ssl(view(spark, sf, "conn"), view(spark, sf, "ssl"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return with_fingerprint(flows(spark, sf))


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return analyse_tls(flows(spark, sf), threat_table(spark))


def with_scores(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Detector outputs of the ``scores`` view under their column names."""
    s = view(spark, sf, "scores").select(
        "uid",
        F.col("iso").alias("isolation_forest_score"),
        F.col("rf").alias("random_forest_score"),
        F.col("seq").alias("sequence_score"),
        F.col("stat").alias("statistical_score"),
        F.col("label").alias("attack_label"),
        F.col("alt_label").alias("alternative_label"),
    )
    return df.join(s, "uid")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_risk(with_scores(analysed(spark, sf), spark, sf))


def traffic(spark: SparkSession, sf: str) -> DataFrame:
    return flow_records(scored(spark, sf))


def fired(spark: SparkSession, sf: str) -> DataFrame:
    return alerts_only(scored(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return with_features(view(spark, sf, "conn")).select("uid", "ts", *FEATURE_NAMES)


def netflow(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels. Features cost far more time than the reading, so events in few partitions are dealt to all cores first."""
    events = spread(view(spark, sf, "events"))
    conn = spark.sql(VIEWS["conn"], events=events)
    labels = spark.sql(VIEWS["train_labels"], conn=conn).select("uid", F.col("attack").alias("Attack"), F.col("label").alias("Label"))
    return with_features(conn).select("uid", "ts", *FEATURE_NAMES).join(labels, "uid")
