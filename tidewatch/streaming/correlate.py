"""Correlation of live logs by uid.

``correlate_stream`` is the main form: one union, one watermark, one state store. A flow comes out
when its uid has been quiet for the TTL and the watermark has passed that. ``correlate_early`` gives
flows as soon as connection and TLS record are both there, or the coalescing delay after the first
record, at the price of Python state per bucket of uids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import DEFAULTS, Settings
from tidewatch.operators.correlate import flatten_sources, latest_per_log, tagged_union
from tidewatch.streaming.run import ROCKSDB

_BUCKETS = 4096  # uids by hash; a running stream can't change it
_SORTED_ROWS = 50_000  # records of one bucket in one batch are taken in the order of time, so many at once


def _watermarked(logs: dict[str, DataFrame], delay_seconds: int) -> DataFrame:
    rows = tagged_union(logs).filter(F.col("uid").isNotNull() & (F.col("uid") != ""))
    return rows.withWatermark("ts", f"{delay_seconds} seconds")


def correlate_stream(logs: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Append-mode stream of flows, with the rules of the batch ``correlate``.

    Records of one uid are merged in every map task before the shuffle, so that a uid with most of
    the records sends one row per task.
    """
    spark = next(iter(logs.values())).sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return correlate_tagged(_watermarked(logs, settings.uid_ttl_seconds), logs, settings)


def correlate_tagged(rows: DataFrame, logs: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    names = list(logs)
    sessions = (
        rows.groupBy("uid", F.session_window("ts", f"{settings.uid_ttl_seconds} seconds"))
        .agg(*latest_per_log(names))
        .filter(F.col("conn").isNotNull())
        .select("uid", *[F.col(f"{n}._rec").alias(n) for n in names])
    )
    return flatten_sources(sessions, logs)


def _plain(record) -> tuple | None:
    """A record as a tuple of its fields: what the state takes inside of lists."""
    return None if record is None else tuple(record.values() if isinstance(record, dict) else record)


class _Entries(StatefulProcessor):
    """One entry per uid: the last record of each log, typed, and the times of its first and last record. The entries of all uids of a
    bucket are one value with one timer, the earliest that is due: a batch reads and writes a bucket once, not every uid."""

    def __init__(self, names: list[str], schema: T.StructType, delay_ms: int, ttl_ms: int):
        self.names, self.schema, self.delay_ms, self.ttl_ms = names, schema, delay_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bucket = handle, handle.getValueState("bucket", self.schema)

    def _load(self) -> tuple[dict[str, list], int | None]:
        """Per uid: records by log, time of the first and of the last, when it is due; and the timer of the bucket."""
        value = self.bucket.get()
        if value is None:
            return {}, None
        entries, timer = value
        held = {}
        for uid, *records, first, last, due in entries:
            held[uid] = [{n: _plain(r) for n, r in zip(self.names, records, strict=True) if r is not None}, first, last, due]
        return held, timer

    def _keep(self, held: dict[str, list], before: int | None, timer: int | None) -> None:
        """``before``: a timer to be replaced."""
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if not held:
            self.bucket.clear()
            return
        self.bucket.update(([(uid, *[r.get(n) for n in self.names], *times) for uid, (r, *times) in held.items()], timer))
        if timer != before:
            self.handle.registerTimer(timer)

    def _flow(self, uid: str, records: dict) -> Row:
        return Row("uid", *self.names)(uid, *[records.get(n) for n in self.names])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, before = self._load()
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        rows = iter(rows)
        while some := sorted(islice(rows, _SORTED_ROWS), key=lambda r: r["at"]):
            for row in some:
                at, entry = row["at"] // 1000, held.setdefault(row["uid"], [{}, None, None, None])
                records, first, last, _ = entry
                entry[1], entry[2] = at if first is None else min(first, at), at if last is None else max(last, at)
                records.update({n: _plain(row[n]) for n in self.names if row[n] is not None})
                if "conn" in records and "ssl" in records:
                    yield self._flow(row["uid"], records)
                    del held[row["uid"]]
                else:
                    entry[3] = max(entry[1] + self.delay_ms if "conn" in records else entry[2] + self.ttl_ms, soonest)
        self._keep(held, before, min((e[3] for e in held.values()), default=None))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, _ = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for uid in [uid for uid, entry in held.items() if entry[3] <= now]:
            records = held.pop(uid)[0]
            if "conn" in records:
                yield self._flow(uid, records)
        self._keep(held, None, min((e[3] for e in held.values()), default=None))

    def close(self) -> None:
        pass


def correlate_early(logs: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Low-latency form, an entry per uid, kept in keyed state by buckets of uids with event-time timers.

    Emits when conn and ssl are both present, else once the watermark is past the coalescing delay
    and a conn record is there. Without one the entry is dropped a TTL after its last record.
    Event time runs ``early_lateness_seconds`` behind the newest record, so a connection without TLS
    waits that long and the coalescing delay, not the TTL. A side
    record that comes after the flow was emitted opens an entry of its own and is dropped in time.
    Records are kept under their own types, to the microsecond; state lives in the RocksDB store, which timers need.
    """
    names, spark = list(logs), next(iter(logs.values())).sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = _watermarked(logs, settings.early_lateness_seconds).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    bodies = [T.StructField(n, rows.schema[n].dataType) for n in names]
    out = T.StructType([T.StructField("uid", T.StringType()), *bodies])
    times = [T.StructField(n, T.LongType()) for n in ("first_ms", "last_ms", "due_ms")]
    entry = T.StructType([T.StructField("uid", T.StringType()), *bodies, *times])
    state = T.StructType([T.StructField("entries", T.ArrayType(entry)), T.StructField("timer_ms", T.LongType())])
    entries = _Entries(names, state, settings.coalesce_seconds * 1000, settings.uid_ttl_seconds * 1000)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("uid"), F.lit(_BUCKETS)))
    merged = rows.groupBy("_bucket").transformWithState(entries, out, "Append", "EventTime")
    return flatten_sources(merged, logs)
