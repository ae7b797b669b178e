"""Running reports: partial aggregates per micro-batch, merged when they are read.

A ``Report`` says how the rows of a batch become a small partial table, how partial tables are merged into one of the same
form, and how the merged one becomes the report. ``Running`` keeps the partial table of each batch under the batch's
number: a batch that runs again overwrites its own, so nothing counts twice. Every ``compact_every`` batches what earlier
batches left is merged into one table, so neither a batch nor a reading becomes dearer with the number of batches. Only tables that
were written whole count. Merged tables are deleted one compaction later, when no reader that began before it needs them.

Sums, minima and the newest rows merge exactly. The counter summary (``frequent_fingerprints``) keeps the ``kept`` largest counters
with a bound of what any other can have, and settles its report by an exact second step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import DEFAULTS, Settings
from tidewatch.operators import kpi
from tidewatch.sources.storage import drop_tables

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Report:
    partial: Step
    merged: Step  # of partial tables, one after the other; ``_part`` names the table a row is from
    finished: Step
    trimmed: Step = lambda merged: merged  # before a merged table is written


def _summed(partial: Step, keys: list[str], sums: list[str], finished: Step = lambda p: p) -> Report:
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    return Report(partial, lambda p: p.groupBy(*keys).agg(*totals) if keys else p.agg(*totals), finished)


def traffic_totals() -> Report:
    return _summed(kpi.traffic_totals, [], ["flows_total", "bytes_in_total", "bytes_out_total", "benign_count", "malicious_count"])


def alerts_total(settings: Settings = DEFAULTS) -> Report:
    return _summed(lambda rows: kpi.alerts_total(rows, settings), [], ["alerts_total"])


def protocol_breakdown() -> Report:
    return _summed(kpi.protocol_breakdown, ["proto"], ["flows"])


def flow_rate(seconds: int = 1) -> Report:
    rate = F.floor(F.col("flows") / seconds).alias("flows_per_sec")
    return _summed(
        lambda rows: kpi.flow_rate(rows, seconds).drop("flows_per_sec"), ["window_start"], ["flows"], lambda p: p.select("window_start", "flows", rate)
    )


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ja3").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("ts", "uid")).alias("first"))


def _counts_merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ja3").agg(F.sum("hits").alias("hits"), F.min("first").alias("first"))


def fingerprint_frequency() -> Report:
    """ja3, hits: a counter per fingerprint."""
    return Report(_counted, _counts_merged, lambda p: p.select("ja3", "hits"))


def fingerprint_stats(threats: DataFrame) -> Report:
    """As ``kpi.fingerprint_stats``, exact: a counter per fingerprint."""
    known = threats.select("ja3", F.lit(1).alias("known"))

    def stats(counts: DataFrame) -> DataFrame:
        return counts.join(known, "ja3", "left").agg(
            F.count(F.lit(1)).alias("unique_ja3_count"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_fingerprinted"), F.count("known").alias("threats_detected")
        )

    return Report(_counted, _counts_merged, stats)


def fingerprint_stats_approximate(precision: int = 14) -> Report:
    """unique_ja3_count by a mergeable sketch of 2**precision registers, whatever the number of fingerprints: its standard error is
    1.04 / sqrt(2**precision) (0.8 % by default); total_fingerprinted is exact."""
    return Report(
        lambda rows: rows.agg(F.hll_sketch_agg("ja3", precision).alias("sketch"), F.count(F.lit(1)).alias("total_fingerprinted")),
        lambda p: p.agg(F.hll_union_agg("sketch").alias("sketch"), F.coalesce(F.sum("total_fingerprinted"), F.lit(0)).alias("total_fingerprinted")),
        lambda p: p.select(F.hll_sketch_estimate("sketch").alias("unique_ja3_count"), "total_fingerprinted"),
    )


def _newest(n: int, finished: Step) -> Report:
    def first(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("timestamp"), "uid").limit(n)

    return Report(first, lambda p: first(p.drop("_part")), finished)


def recent_alerts(limit: int | None = None, severity: str = "", settings: Settings = DEFAULTS) -> Report:
    """The alert feed: of each batch the newest rows that the feed can show, at most its length."""
    return _newest(settings.alert_feed, lambda p: kpi.recent_alerts(p, limit, severity, settings))


def recent_flows(limit: int | None = None, settings: Settings = DEFAULTS) -> Report:
    return _newest(settings.flow_feed, lambda p: kpi.recent_flows(p, limit, settings))


def _for_others(of: DataFrame, unseen: Column | int) -> DataFrame:
    """The row that says how many hits a fingerprint without a counter may have."""
    first = F.lit(None).cast("struct<ts:timestamp,uid:string>").alias("first")
    unseen = F.lit(unseen) if isinstance(unseen, int) else unseen
    return of.select(F.lit(None).cast("string").alias("ja3"), F.lit(0).cast("bigint").alias("hits"), first, unseen.cast("bigint").alias("unseen"))


def _largest(summary: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` + 1 counters that can be largest, and the bound for what goes."""
    possible = F.col("hits") + F.col("unseen")
    best = summary.filter("ja3 is not null").orderBy(possible.desc(), "first", "ja3").limit(kept + 1)
    named = F.col("ja3").isNotNull()
    # what goes can have as many hits as the least of what stays
    bound = best.unionByName(summary.filter("ja3 is null")).agg(
        F.when(F.count_if(named) > kept, F.min(F.when(named, possible))).alias("least"), F.max(F.when(~named, F.col("unseen"))).alias("rest")
    )
    return best.unionByName(_for_others(bound, F.coalesce(F.greatest("least", "rest"), F.lit(0))))


def frequent_fingerprints(flows: Callable[[], DataFrame], n: int = 10, kept: int = 1000) -> Report:
    """As ``kpi.top_fingerprints``, exact, with ``kept`` + 1 counters for each batch and for what compactions merged, however many
    fingerprints there are. A counter has the hits it has seen and how many it may have missed; a row without a name says that for all
    fingerprints without a counter. ``flows`` reads the stored flows (ja3, ts, uid) of all batches taken: where the bounds leave
    the order of some counters open, only their flows are counted again; where even a fingerprint without a counter may be
    among the first n, all are. Flows without a fingerprint don't count."""

    def partial(rows: DataFrame) -> DataFrame:
        counts = _counted(rows.filter("ja3 is not null"))
        first = F.struct(F.col("first.ts").cast("timestamp").alias("ts"), F.col("first.uid").alias("uid")).alias("first")
        return _largest(counts.select("ja3", "hits", first, F.lit(0).cast("bigint").alias("unseen")), kept)

    def merged(parts: DataFrame) -> DataFrame:
        bounds = parts.filter("ja3 is null").select("_part", F.col("unseen").alias("bound"))
        whole = bounds.agg(F.sum("bound").alias("unseen"))
        total = int(whole.first()["unseen"] or 0)
        # a part without a counter may have as many hits as its bound says, a part with one as many as that has missed
        less = F.sum(F.col("unseen") - F.col("bound"))
        named = parts.filter("ja3 is not null").join(bounds, "_part").groupBy("ja3").agg(
            F.sum("hits").alias("hits"), F.min("first").alias("first"), (F.lit(total) + less).cast("bigint").alias("unseen")
        )
        return named.unionByName(_for_others(whole, total))

    def finished(summary: DataFrame) -> DataFrame:
        named = summary.filter("ja3 is not null")
        unseen = summary.filter("ja3 is null").first()["unseen"]
        top = named.orderBy(F.desc("hits")).limit(n).agg(F.count(F.lit(1)).alias("n"), F.min("hits").alias("nth")).first()
        few = top["n"] < n
        if unseen and (few or unseen >= top["nth"]):
            return kpi.top_fingerprints(flows().filter("ja3 is not null"), n)
        in_question = named if few else named.filter(F.col("hits") + F.col("unseen") >= top["nth"])
        if in_question.filter("unseen > 0").isEmpty():
            return in_question.orderBy(F.desc("hits"), "first", "ja3").limit(n).select("ja3", "hits")
        return kpi.top_fingerprints(flows().join(in_question.select("ja3"), "ja3", "left_semi"), n)

    return Report(partial, merged, finished, lambda summary: _largest(summary, kept))


@dataclass
class Running:
    """Reports over one stream, under ``path``."""

    path: str
    reports: dict[str, Report]
    compact_every: int = 100

    def take(self, rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for name, report in self.reports.items():
                report.partial(rows).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        finally:
            rows.unpersist()
        if batch and batch % self.compact_every == 0:
            for name in self.reports:
                self._compact(rows.sparkSession, name, batch - 1)

    def start(self, flows: DataFrame, progress: str, available_now: bool = False) -> StreamingQuery:
        writer = flows.writeStream.option("checkpointLocation", progress).foreachBatch(self.take)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The report over all batches taken so far."""
        through, batches = self._whole(spark, name)
        used = [f"through={t}" for t in through[-1:]] + [f"batch={b}" for b in batches if not through or b > through[-1]]
        if not used:
            raise ValueError(f"no batch has been taken for {name}")
        return self.reports[name].finished(self._merged(spark, name, used))

    def _merged(self, spark: SparkSession, name: str, used: list[str]) -> DataFrame:
        whole = spark.read.parquet(*[f"{self.path}/{name}/{u}" for u in used])
        return self.reports[name].merged(whole.withColumn("_part", F.regexp_extract(F.input_file_name(), "/((batch|through)=[0-9]+)/", 1)))

    def _whole(self, spark: SparkSession, name: str) -> tuple[list[int], list[int]]:
        """Numbers of the merged tables and of the batches that were written whole, ascending."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"through": [], "batch": []}
        if files.exists(where):
            for status in files.listStatus(where):
                kind, _, number = status.getPath().getName().partition("=")
                if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found[kind].append(int(number))
        return sorted(found["through"]), sorted(found["batch"])

    def _compact(self, spark: SparkSession, name: str, last: int) -> None:
        """Merge what batches up to ``last`` left; they are committed, so they won't run again."""
        through, batches = self._whole(spark, name)
        if last in through:
            return
        done = through[-1] if through else -1
        used = [f"through={t}" for t in through[-1:]] + [f"batch={b}" for b in batches if done < b <= last]
        if used:
            self.reports[name].trimmed(self._merged(spark, name, used)).write.mode("overwrite").parquet(f"{self.path}/{name}/through={last}")
            drop_tables(spark, [f"{self.path}/{name}/batch={b}" for b in batches if b <= done] + [f"{self.path}/{name}/through={t}" for t in through[:-1]])
