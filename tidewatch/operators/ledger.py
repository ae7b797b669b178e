"""Block ledger: which address was blocked from when to when.

A blocking alert (or a manual block) blocks its source for a fixed time; whatever else arrives for a
blocked source is ignored; at expiry the next one blocks anew. A manual unblock ends an open block.
Alerts are handled before manual actions of the same instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULTS, Settings
from tidewatch.operators.risk import identities
from tidewatch.sources.storage import materialise

MANUAL_SCORE = 100
_SLOTS = (60_000_000, 1_000_000, 1_000)
_BROADCAST_ADDRESSES = 100_000
_CARRIED, _ALERT, _MANUAL, _UNBLOCK = -1, 0, 1, 2
LEDGER_SCHEMA = (
    "ip string, start_us bigint, expiry_us bigint, end_us bigint, score int, source string, ended_by string, carried boolean"
)


def blocking_events(scored: DataFrame) -> DataFrame:
    """(ip, ts, uid, score) of the flows that call for a block."""
    return scored.filter("should_block").select(
        identities(scored)["src_ip"].alias("ip"), "ts", "uid", F.col("risk_score").alias("score")
    )


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def alert_starts(events: DataFrame) -> DataFrame:
    """(ip, t, kind, uid, score) of the alerts that can open a block."""
    return events.select("ip", _us(F.col("ts")).alias("t"), F.lit(_ALERT).alias("kind"), "uid", "score")


def manual_starts(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("action") == "block").select(
        "ip", _us(F.col("ts")).alias("t"), F.lit(_MANUAL).alias("kind"), F.lit("").alias("uid"), F.lit(MANUAL_SCORE).alias("score")
    )


def manual_unblocks(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("action") == "unblock").select(
        "ip", _us(F.col("ts")).alias("t"), F.lit(_UNBLOCK).alias("kind"), F.lit("").alias("uid"), F.lit(0).alias("score")
    )


def _starts(events: DataFrame, actions: DataFrame | None, open_blocks: DataFrame | None) -> DataFrame:
    """Everything that can open a block, one row per address and instant (combined on the map side)."""
    rows = alert_starts(events)
    if actions is not None:
        rows = rows.unionByName(manual_starts(actions))
    if open_blocks is not None:
        carried = open_blocks.select(
            "ip", F.col("start_us").alias("t"), F.lit(_CARRIED).alias("kind"), F.col("source").alias("uid"), "score"
        )
        # an alert or manual block from before a carried block's start is late: that block stands, and it is in the ledger
        known = carried.groupBy("ip").agg(F.max("t").alias("_since"))
        rows = rows.join(known, "ip", "left").filter(F.col("_since").isNull() | (F.col("t") >= F.col("_since"))).drop("_since")
        rows = rows.unionByName(carried)
    first = F.min(F.struct("kind", "uid", "score")).alias("p")
    return (
        rows.filter(F.col("ip").isNotNull() & F.col("t").isNotNull())
        .groupBy("ip", "t")
        .agg(first)
        .select("ip", "t", F.col("p.kind").alias("kind"), F.col("p.uid").alias("uid"), F.col("p.score").alias("score"))
    )


def _ends(t: int, duration: int, unblocks: np.ndarray) -> tuple[int, bool]:
    """End of a block opened at ``t``, and whether an unblock ended it."""
    i = int(np.searchsorted(unblocks, t, "left"))
    if i < len(unblocks) and unblocks[i] < t + duration:
        return int(unblocks[i]), True
    return t + duration, False


def next_starts(ip: np.ndarray, t: np.ndarray, kind: np.ndarray, duration: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of (ip, t, kind), ``ip`` being numbers that grow: the starts among them, and for each, if it opens a block, the end
    of it, whether an unblock ends it, and the place (among the starts) of the next one that opens a block; that of another address, or
    beyond the last, if there is none. All by search in sorted arrays."""
    starts, unblocks = np.flatnonzero(kind != _UNBLOCK), np.flatnonzero(kind == _UNBLOCK)
    low = int(t.min()) if len(t) else 0
    stride = (int(t.max()) - low if len(t) else 0) + duration + 2
    if len(ip) and (int(ip[-1]) + 1) * stride >= 2**62:
        raise OverflowError("too many addresses for one batch")
    clock = ip * stride + (t - low)
    end, cut = t[starts] + duration, np.zeros(len(starts), dtype=bool)
    after = np.searchsorted(clock[starts], clock[starts] + duration, "left")
    if len(unblocks):
        place = np.searchsorted(unblocks, starts, "right")  # the next unblock, those of the same instant come after a start
        own = np.minimum(place, len(unblocks) - 1)
        cut = (place < len(unblocks)) & (clock[unblocks[own]] < clock[starts] + duration)
        end = np.where(cut, t[unblocks[own]], end)
        after = np.where(cut, np.searchsorted(starts, unblocks[own], "right"), after)
    return starts, end, cut, after


def opened(ip: np.ndarray, starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which starts open a block: the first of each address, and from there on pointer by pointer, all addresses at once."""
    owner = ip[starts]
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(starts) else starts
    found = [at]
    while len(at):
        beyond = after[at]
        kept = np.flatnonzero(beyond < len(starts))
        kept = kept[owner[beyond[kept]] == owner[at[kept]]]
        at = beyond[kept]
        found.append(at)
    return np.sort(np.concatenate(found))


def _walk(duration: int):
    """Runs over rows sorted by (ip, t, kind) and holds one open block, so neither the number of addresses nor the rows of one
    address cost memory, and time in Python goes by blocks, not by rows."""
    fields = [f.split()[0] for f in LEDGER_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    inputs = pa.schema([("ip", pa.string()), ("t", pa.int64()), ("kind", pa.int32()), ("uid", pa.string()), ("score", pa.int32())])

    def blocks(rows: pa.RecordBatch, more: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Blocks that are over, and as a row the one that later rows may still bear on."""
        names, t, kind = rows.column(0), rows.column(1).to_numpy(), rows.column(2).to_numpy()
        new = np.ones(len(names), dtype=bool)
        new[1:] = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False) if len(names) else []
        ip = np.cumsum(new) - 1
        starts, end, cut, after = next_starts(ip, t, kind, duration)
        own = opened(ip, starts, after)
        held = rows.slice(0, 0)
        if more and len(own) and ip[starts[own[-1]]] == ip[-1] and not cut[own[-1]] and end[own[-1]] > t[-1]:
            held, own = rows.slice(int(starts[own[-1]]), 1), own[:-1]
        taken = rows.take(pa.array(starts[own]))
        kinds = kind[starts[own]]
        source = [u if k == _CARRIED else ("auto" if k == _ALERT else "manual") for u, k in zip(taken.column(3).to_pylist(), kinds.tolist(), strict=True)]
        begin = t[starts[own]]
        columns = [taken.column(0), begin, begin + duration, end[own], taken.column(4), source, np.where(cut[own], "unblock", "expiry").tolist(), kinds == _CARRIED]
        return pa.RecordBatch.from_arrays([pa.array(c, ty) if not isinstance(c, pa.Array) else c.cast(ty) for c, ty in zip(columns, types, strict=True)], names=fields), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.RecordBatch.from_pylist([], schema=inputs)
        for batch in batches:
            if batch.num_rows:
                batch = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in inputs], schema=inputs)
                t = batch.column(1).to_numpy()
                span = int(t.max()) - min([int(t.min()), *held.column(1).to_pylist()]) + duration + 2
                most = max(1, 2**61 // span)  # rows whose addresses and times fit one number: all, unless times are centuries apart
                for at in range(0, batch.num_rows, most):
                    # the open block goes before the rows that may end it
                    rows = pa.Table.from_batches([held, batch.slice(at, most)]).combine_chunks().to_batches()[0]
                    done, held = blocks(rows, True)
                    yield done
        if held.num_rows:
            yield blocks(held, False)[0]

    return run


def _unsettled(duration: int, slot: int):
    """Slots whose single rows can decide where a block starts.

    Walks the slots' first and last instants with an interval for the start that is still open. The
    first instant at or after a threshold is known from the slot bounds alone unless the threshold
    falls inside a slot; such slots are reported, and the interval carried on covers both outcomes.
    """

    def run(slots: pd.DataFrame, unblocks: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values("s")
        s, lo, hi = (slots[c].to_numpy(np.int64) for c in ("s", "lo", "hi"))
        u = np.sort(unblocks["t"].to_numpy(np.int64))
        wanted: set[int] = set()
        if len(s):
            a = b = int(lo[0])
            while True:
                (end_a, cut_a), (end_b, cut_b) = _ends(a, duration, u), _ends(b, duration, u)
                from_a, from_b = end_a + cut_a, end_b + cut_b
                # slots that still have an instant at or after each threshold
                i, j = int(np.searchsorted(hi, from_a, "left")), int(np.searchsorted(hi, from_b, "left"))
                inside = np.arange(i, min(j + 1, len(s)))
                open_slots = inside[(lo[inside] < from_b) & (lo[inside] < hi[inside])]
                if a != b or (len(open_slots) and lo[open_slots[0]] < from_a):
                    wanted.update(int(x) for x in s[open_slots])
                if i >= len(s):
                    break
                next_a = max(from_a, int(lo[i]))
                if j >= len(s):
                    next_b = int(hi[-1])
                else:
                    next_b = int(lo[j]) if from_b <= lo[j] else int(hi[j])
                a, b = next_a, max(next_a, next_b)
        ip = slots["ip"].iloc[0] if len(slots) else None
        return pd.DataFrame({"ip": pd.Series([ip] * len(wanted), dtype=object), "s": sorted(wanted)})

    return run


def thin_out(starts: DataFrame, unblocks: DataFrame, duration: int, slot: int) -> DataFrame:
    """Drop rows that cannot open a block, exactly: keep each time slot's first row, and all rows of
    the slots in which a block start is not settled by the slot bounds. Slots per address are bounded
    by the time range, whatever the number of alerts."""
    slotted = starts.withColumn("s", F.floor(F.col("t") / slot))
    bounds = slotted.groupBy("ip", "s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by_ip = bounds.groupBy("ip").cogroup(unblocks.groupBy("ip"))
    needed = by_ip.applyInPandas(_unsettled(duration, slot), "ip string, s bigint")
    kept = slotted.join(bounds.select("ip", "s", "lo"), ["ip", "s"]).join(needed.withColumn("_open", F.lit(True)), ["ip", "s"], "left")
    return kept.filter((F.col("t") == F.col("lo")) | F.col("_open")).select(*starts.columns)


def block_ledger(
    events: DataFrame,
    actions: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    open_blocks: DataFrame | None = None,
    hot_rows: int = 200_000,
) -> DataFrame:
    """Ledger of all blocks. ``events``: (ip, ts, uid, score) of blocking alerts; ``actions``:
    (ip, ts, action) with action block or unblock; ``open_blocks``: ledger rows of an earlier run
    that were still open, which come back marked ``carried``. Whatever would open a block of an address before the start
    of its carried one comes too late and is ignored, so an address has one block at a time.

    Addresses of more than ``hot_rows`` instants are thinned out first, by minutes, seconds and then
    milliseconds, so that what one task gets of an address is bounded by the time range.
    """
    spark = events.sparkSession
    duration = settings.block_seconds * 1_000_000
    starts = materialise(_starts(events, actions, open_blocks))
    if actions is not None:
        unblocks = actions.filter(F.col("action") == "unblock").select("ip", _us(F.col("ts")).alias("t")).distinct()
    else:
        unblocks = spark.createDataFrame([], "ip string, t bigint")
    hot = starts.groupBy("ip").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select("ip")
    candidates = starts
    hot = materialise(hot)
    busy_addresses = hot.count()
    if busy_addresses:
        # telling busy addresses apart must not gather their rows by address again
        if busy_addresses <= _BROADCAST_ADDRESSES:
            hot = F.broadcast(hot)
        busy = starts.join(hot, "ip", "left_semi")
        for slot in _SLOTS:
            if slot * 10 <= duration:
                busy = materialise(thin_out(busy, unblocks, duration, slot))
        candidates = starts.join(hot, "ip", "left_anti").unionByName(busy)
    ends = unblocks.select("ip", "t", F.lit(_UNBLOCK).alias("kind"), F.lit("").alias("uid"), F.lit(0).alias("score"))
    in_order = candidates.unionByName(ends).repartition("ip").sortWithinPartitions("ip", "t", "kind")
    return in_order.mapInArrow(_walk(duration), LEDGER_SCHEMA)


def active_blocks(ledger: DataFrame, at_us: int) -> DataFrame:
    """Blocks in force at an instant, with whole seconds left until expiry."""
    return ledger.filter((F.col("start_us") <= at_us) & (F.col("end_us") > at_us)).select(
        "ip", F.floor((F.col("expiry_us") - F.lit(at_us)) / 1_000_000).alias("expires_in")
    )


def blocked_count(ledger: DataFrame, at_us: int) -> DataFrame:
    return active_blocks(ledger, at_us).agg(F.count(F.lit(1)).alias("blocked_count"))
