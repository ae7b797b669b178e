"""The block ledger as keyed state: one state per bucket of addresses, blocks come out when they are over.

An address holds its open block and the starts and unblocks that the watermark has not passed yet, since an earlier one may still
arrive. What the watermark has passed is settled in order, by the rules of the batch ledger, and dropped unless it is the open block,
so a busy address holds one start for each instant of the waiting time at most. All addresses of a bucket are settled at once, in sorted
arrays, so calls and state values go by buckets, not by addresses. A timer per bucket ends its
blocks at expiry without any event. Events that come later than the waiting time are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.config import DEFAULTS, Settings
from tidewatch.operators.ledger import alert_starts, manual_starts, manual_unblocks, next_starts, opened

_OUT = "ip string, start_us bigint, expiry_us bigint, end_us bigint, score int, source string, ended_by string"
# the open blocks, then what waits, in order
_STATE = (
    "open_ip array<string>, open_us array<bigint>, open_score array<int>, open_kind array<int>, "
    "ip array<string>, t array<bigint>, kind array<int>, uid array<string>, score array<int>"
)
_UNBLOCK = 2
_HELD = ["ip", "t", "score", "kind"]
_EVENT = ["ip", "t", "kind", "uid", "score"]
_BUCKETS = 256


def _settle(rows: pd.DataFrame, open_blocks: pd.DataFrame, duration: int, upto: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Blocks that are over by ``upto``, and those still open then, one of an address at most. ``rows``: events before ``upto``, an address's
    in order and none from before its open block."""
    both = pd.concat([open_blocks, rows[_HELD]], ignore_index=True)
    number = pd.factorize(both["ip"])[0]
    order = np.lexsort((both["t"].to_numpy(np.int64), number))  # keeps what is equal in place: an open block goes first
    both, number = both.iloc[order], number[order]
    ip, t, kind = both["ip"].to_numpy(object), both["t"].to_numpy(np.int64), both["kind"].to_numpy(np.int64)
    span = int(t.max()) - int(t.min()) + duration + 2 if len(t) else 1
    most = max(1, 2**61 // span)  # addresses whose numbers and times fit one number: all, unless times are centuries apart
    edges = np.append(np.searchsorted(number, np.arange(0, int(number[-1]) + 1 if len(number) else 1, most)), len(number))
    own, ends, cuts = [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part = number[a:b] - (number[a] if b > a else 0)
        starts, end, cut, after = next_starts(part, t[a:b], kind[a:b], duration)
        found = opened(part, starts, after)
        own.append(starts[found] + a), ends.append(end[found]), cuts.append(cut[found])
    at, end, cut = (np.concatenate(x) for x in (own, ends, cuts))
    still = ~cut & (end > upto)  # only an address's last one can be
    over, left = at[~still], both.iloc[at[still]]
    done = pd.DataFrame(
        {
            "ip": ip[over],
            "start_us": t[over],
            "expiry_us": t[over] + duration,
            "end_us": end[~still],
            "score": both["score"].to_numpy(np.int64)[over],
            "source": np.where(kind[over] == 0, "auto", "manual").astype(object),
            "ended_by": np.where(cut[~still], "unblock", "expiry").astype(object),
        }
    )
    return done, left


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the starts of an address's instant the first counts; unblocks come after them."""
    ordered = rows.assign(ends=rows["kind"] == _UNBLOCK).sort_values(["ip", "t", "ends", "kind", "uid", "score"])
    return ordered.drop_duplicates(["ip", "t", "ends"])


def _step(duration: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * 9
        open_blocks = pd.DataFrame(dict(zip(("ip", "t", "score", "kind"), held[:4], strict=True)))
        rows = pd.DataFrame(dict(zip(_EVENT, held[4:], strict=True)))
        if not state.hasTimedOut:
            for batch in batches:  # of what comes only what can count is held
                rows = _in_order(pd.concat([rows, batch[_EVENT]], ignore_index=True) if len(rows) else batch[_EVENT])
        rows = _in_order(rows)
        passed = state.getCurrentWatermarkMs() * 1000
        since = dict(zip(open_blocks["ip"], open_blocks["t"], strict=True))
        # others come from before a block that is open already
        rows = rows[rows["t"].to_numpy(np.int64) >= np.array([since.get(ip, -(2**62)) for ip in rows["ip"]], dtype=np.int64)]
        settled = rows["t"] < passed
        over, open_blocks = _settle(rows[settled], open_blocks, duration, passed)
        waiting = rows[~settled]
        if open_blocks.empty and waiting.empty:
            if state.exists:
                state.remove()
        else:
            # plain numbers: the state doesn't take numpy's
            plain = lambda part, c: [str(v) for v in part[c]] if c in ("ip", "uid") else [int(v) for v in part[c]]
            state.update((*(plain(open_blocks, c) for c in _HELD), *(plain(waiting, c) for c in _EVENT)))
            due = [int(waiting["t"].min())] if len(waiting) else []
            due += [int(open_blocks["t"].min()) + duration] if len(open_blocks) else []
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield over

    return step


def ledger_stream(events: DataFrame, actions: DataFrame | None = None, settings: Settings = DEFAULTS, delay_seconds: int | None = None, buckets: int = _BUCKETS) -> DataFrame:
    """Append-mode stream of ledger rows, each when its block is over. ``events``: stream of (ip, ts, uid, score) that call for a
    block; ``actions``: stream of (ip, ts, action). ``delay_seconds``: how late an event may come and still count.
    ``buckets`` of addresses share a state each; their number must stay the same while a stream is continued."""
    wait = settings.uid_ttl_seconds if delay_seconds is None else delay_seconds
    rows = alert_starts(events)
    if actions is not None:
        rows = rows.unionByName(manual_starts(actions)).unionByName(manual_unblocks(actions))
    rows = rows.filter(F.col("ip").isNotNull() & F.col("t").isNotNull()).withColumn("score", F.col("score").cast("int"))
    timed = rows.withColumn("at", F.timestamp_micros("t")).withWatermark("at", f"{wait} seconds")
    return timed.withColumn("bucket", F.pmod(F.xxhash64("ip"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        _step(settings.block_seconds * 1_000_000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
