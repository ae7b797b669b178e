"""Fingerprint threat intelligence: the merged table and the lookups against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.fixed_values import (
    BLOCKLIST_DEFAULT_FAMILY,
    CURATED_THREATS,
    JA3_BLOCKLIST,
)

THREAT_COLUMNS = ["ja3", "malware", "severity", "description"]


def _inline(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A literal table. As VALUES it has a known size, so joins with it may be broadcast."""
    quoted = ", ".join(
        "(" + ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r) + ")" for r in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({', '.join(columns)})")


def blocklist_hashes() -> list[str]:
    return [line.split()[0] for line in JA3_BLOCKLIST.strip().splitlines()]


def _fixed_entries() -> list[tuple]:
    """Curated entries, then those of the blocklist that are not curated."""
    rows = [tuple(line.split("|")) for line in CURATED_THREATS.strip().splitlines()]
    curated = {r[0] for r in rows}
    for line in JA3_BLOCKLIST.strip().splitlines():
        ja3, _, family = line.partition(" ")
        family = family or BLOCKLIST_DEFAULT_FAMILY
        if ja3 not in curated:
            rows.append((ja3, family, "critical", f"Matched abuse.ch SSLBL — {family}"))
    return rows


def fixed_threats(spark: SparkSession) -> DataFrame:
    """The entries known without a feed: a literal table of about a hundred rows."""
    return _inline(spark, _fixed_entries(), THREAT_COLUMNS)


def feed_threats(feed: DataFrame) -> DataFrame:
    return feed.select(
        F.col("ja3_md5").alias("ja3"),
        F.col("reason").alias("malware"),
        F.lit("critical").alias("severity"),
        F.concat(
            F.lit("Abuse.ch SSLBL: "), F.col("reason"), F.lit(" (First seen: "), F.col("first_seen"), F.lit(")")
        ).alias("description"),
    )


def merge_by_precedence(sources: list[DataFrame]) -> DataFrame:
    """Union in which an earlier source keeps its entry for a hash. Combines on the map side."""
    ranked = [df.select(*THREAT_COLUMNS, F.lit(rank).alias("_rank")) for rank, df in enumerate(sources)]
    merged = reduce(DataFrame.unionByName, ranked)
    best = F.min(F.struct("_rank", "malware", "severity", "description")).alias("_best")
    return merged.groupBy("ja3").agg(best).select("ja3", *[F.col(f"_best.{c}").alias(c) for c in THREAT_COLUMNS[1:]])


def threat_table(spark: SparkSession, feed: DataFrame | None = None) -> DataFrame:
    """Curated entries, then the blocklist, then the feed."""
    fixed = fixed_threats(spark)
    return fixed if feed is None else merge_by_precedence([fixed, feed_threats(feed)])


def lookup_threats(flows: DataFrame, threats: DataFrame) -> DataFrame:
    """Add ``ja3_malware`` and ``ja3s_malware``: the family the client and server fingerprint match.

    The table is broadcast when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``;
    beyond that the adaptive skew join splits the fingerprints that many flows share.
    """
    client = threats.select(F.col("ja3"), F.col("malware").alias("ja3_malware"))
    server = threats.select(F.col("ja3").alias("ja3s"), F.col("malware").alias("ja3s_malware"))
    return flows.join(client, "ja3", "left").join(server, "ja3s", "left")


def in_blocklist(fingerprint: Column) -> Column:
    """Membership in the fixed blocklist: a hash-set test, no join."""
    return F.coalesce(fingerprint.isin(*blocklist_hashes()), F.lit(False))
