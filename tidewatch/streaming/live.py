"""Live scoring: correlated flows in, alerts, traffic rows and block ledger out, batch by batch.

All state between batches is written per batch id: a batch that is run again reads the state of the
batch before it and overwrites its own, so a lost driver or executor neither repeats nor loses rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import DEFAULTS, Settings
from tidewatch.detectors.ensemble import DetectorSet
from tidewatch.detectors.ewma import EwmaState
from tidewatch.functions.flow_features import with_features
from tidewatch.operators.filters import alerts_only, drop_noise
from tidewatch.operators.ledger import block_ledger, blocking_events
from tidewatch.operators.ordered import ordered_blocks
from tidewatch.operators.risk import alert_records, flow_records
from tidewatch.plans.replay import score_flows
from tidewatch.sources.storage import drop_tables, materialise, scratch_path
from tidewatch.streaming.correlate import correlate_stream

_BLOCK = "ip string, start_us bigint, expiry_us bigint, end_us bigint, score int, source string, ended_by string"


def live_flows(logs: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Correlated flows of the live logs (conn and side logs); connections of too few packets are noise and go first."""
    return correlate_stream(logs | {"conn": drop_noise(logs["conn"], settings.live_min_packets)}, settings)


@dataclass
class LiveScoring:
    out: str
    threats: DataFrame
    detectors: DetectorSet
    settings: Settings = DEFAULTS
    actions: DataFrame | None = None

    def _path(self, table: str, batch: int) -> str:
        return f"{self.out}/{table}/batch={batch}"

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch))

    def _before(self, spark, table: str, batch: int) -> DataFrame | None:
        """All rows of a state table from earlier batches."""
        try:
            rows = spark.read.option("basePath", f"{self.out}/{table}").parquet(f"{self.out}/{table}")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return rows.filter(F.col("batch") < batch)

    def _last(self, spark, table: str, batch: int) -> DataFrame | None:
        """A state table as the batch before left it."""
        if batch == 0:
            return None
        return spark.read.parquet(self._path(table, batch - 1))

    def process(self, flows: DataFrame, batch: int) -> None:
        spark = flows.sparkSession
        previous = self._last(spark, "baseline", batch)
        if previous is None:
            start, lead, clock = self.detectors.baseline, [], None
        else:
            row = previous.first()
            start, lead = EwmaState(row["n"], list(row["mean"]), list(row["var"])), [list(x) for x in row["tail"]]
            clock = row["clock_us"]
        ordered = ordered_blocks(with_features(flows))
        if previous is not None and ordered.rows.isEmpty():  # a batch that only moves the watermark on
            self._put(previous, "baseline", batch)
            self._put(self._last(spark, "open_blocks", batch), "open_blocks", batch)
            return
        scored, after, tail = self.detectors.transform_ordered(ordered, start, lead)
        known = self._before(spark, "fingerprints", batch)
        # first sightings go over the flows several times: the detectors must not run again for each
        detected, path = scratch_path(spark, "detected"), scratch_path(spark, "scored")
        scored.write.parquet(detected)
        stored = spark.read.schema(scored.schema).parquet(detected)
        score_flows(stored, self.threats, self.settings, known).write.parquet(path)
        risky = spark.read.parquet(path)

        top = self.detectors.top_features(3)
        self._put(alerts_only(alert_records(risky, top, self.settings), self.settings), "alerts", batch)
        self._put(flow_records(risky, self.settings), "traffic", batch)
        self._put(risky.filter("first_seen").select("ja3").distinct(), "fingerprints", batch)
        clock = self._blocks(risky, batch, clock)
        state = spark.createDataFrame(
            [(after.n, after.mean, after.var, tail, clock)],
            "n bigint, mean array<double>, var array<double>, tail array<array<double>>, clock_us bigint",
        )
        self._put(state.coalesce(1), "baseline", batch)
        drop_tables(spark, [detected, path])  # all that is kept of the batch is written

    def _blocks(self, risky: DataFrame, batch: int, clock: int | None) -> int | None:
        """Blocks opened by this batch, and earlier ones it may have ended. Of several ledger rows of
        one block the one of the latest batch holds. Manual actions count once, in the batch whose
        events first reach their time. Returns the event time reached."""
        spark = risky.sparkSession
        still_open = self._last(spark, "open_blocks", batch)
        newest = risky.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
        if newest is None:
            empty = spark.createDataFrame([], _BLOCK)
            self._put(empty, "ledger", batch)
            self._put(still_open if still_open is not None else empty, "open_blocks", batch)
            return clock
        reached = max(newest, clock or newest)
        actions = self.actions
        if actions is not None:
            at = F.unix_micros(F.col("ts").cast("timestamp"))
            actions = actions.filter((at <= reached) & (at > (clock if clock is not None else -(2**62))))
        ledger = materialise(block_ledger(blocking_events(risky), actions, self.settings, still_open))
        changed = ~F.col("carried") | (F.col("ended_by") == "unblock")
        self._put(ledger.filter(changed).drop("carried"), "ledger", batch)
        self._put(ledger.filter(F.col("end_us") > reached).drop("carried"), "open_blocks", batch)
        return reached

    def start(self, flows: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = flows.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
