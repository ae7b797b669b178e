"""Putting the logs of one connection together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings

SIDE_LOGS = ("ssl", "dns", "weird")


def prefixed(side: DataFrame, prefix: str) -> DataFrame:
    """Side-log columns get the log's name in front; uid stays bare as the join key."""
    return side.select(*[F.col(c).alias(c if c == "uid" else f"{prefix}_{c}") for c in side.columns])


def join_conn_ssl(conn: DataFrame, ssl: DataFrame) -> DataFrame:
    """Left join on uid; a flow with several TLS records appears once per record.

    One hash exchange per side at most. No hint: a small TLS side is broadcast by its measured
    size, a hot uid is split by the adaptive skew join (the connection side of a left join splits).
    """
    return conn.join(prefixed(ssl, "ssl"), "uid", "left")


def tagged_union(logs: dict[str, DataFrame], event_time: str = "timestamp") -> DataFrame:
    """All logs as one table ``(uid, ts, <log> struct ...)``; a row fills the struct of its own log.

    ``ts`` appears on the outside and inside: outside it orders and groups, inside it stays a field.
    """
    out = None
    for name, df in logs.items():
        body = F.struct(*[F.col(c) for c in df.columns if c != "uid"])
        part = df.select("uid", F.col("ts").cast(event_time).alias("ts"), body.alias(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def latest_per_log(names: list[str]) -> list[Column]:
    """Last record of each log by event time. Ties are settled by content, so reruns agree."""
    return [
        F.max(F.when(F.col(n).isNotNull(), F.struct(F.col("ts").alias("_at"), F.col(n).alias("_rec")))).alias(n)
        for n in names
    ]


def flatten_sources(sessions: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Wide flow rows from one struct per log: conn fields bare, side fields prefixed."""
    columns = [F.col("uid")]
    for name, df in logs.items():
        for c in df.columns:
            if c != "uid":
                columns.append(F.col(f"{name}.{c}").alias(c if name == "conn" else f"{name}_{c}"))
    return sessions.select(*columns)


def correlate(logs: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Batch correlation of up to four logs with the live rules: records of one uid belong together
    while none is later than the TTL after the one before; the last record per log wins; groups
    without a connection record are dropped.

    Records are first reduced per (uid, TTL-long time slot), combining on the map side: two records
    in one slot are always less than a TTL apart. Only slot summaries are then put in order per uid,
    and a uid has no more of those than the time range has slots, however many records it owns.
    """
    names = list(logs)
    ttl_us = settings.uid_ttl_seconds * 1_000_000
    rows = tagged_union(logs)
    slots = (
        rows.filter(F.col("uid").isNotNull() & (F.col("uid") != "") & F.col("ts").isNotNull())
        .withColumn("_slot", F.expr(f"unix_micros(ts) div {ttl_us}"))
        .groupBy("uid", "_slot")
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), *latest_per_log(names))
    )
    in_order = Window.partitionBy("uid").orderBy("_slot")
    gap = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(in_order))
    sessions = (
        slots.withColumn("_new", F.when(gap.isNull() | (gap > ttl_us), 1).otherwise(0))
        .withColumn("_session", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("uid", "_session")
        .agg(*[F.max(n).alias(n) for n in names])
        .filter(F.col("conn").isNotNull())
        .select("uid", *[F.col(f"{n}._rec").alias(n) for n in names])
    )
    return flatten_sources(sessions, logs)
