"""Events of a stream held back in a buffer of each key, and let go of in batches by number or by age."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "ids array<long>, opened long, dropped long"


def buffered(events: DataFrame, by: str, count: int, seconds: int, most: int | None = None, late: str = "1 hour") -> DataFrame:
    """(by, opened, n, dropped, ids, reason) of the batches of a stream of events (by, event_id, ts).

    A key's buffer opens with an event. It is let go of when it holds `count` (reason count), when an event comes
    `seconds` after it opened or the watermark, `late` behind the newest event of all, has passed that time (reason
    time). It holds the ids of the `most` latest events at most (all of them by default): older ones are dropped and
    their number is kept, so that n + dropped is the number of events. Events of a key within one trigger are taken in
    order of ts and event_id; events behind the watermark, or without a time, are left out, and a null key is a key. A row
    without an event_id is no event but closes its key's buffer (reason close). Once all input of a stream is read,
    buffers that are neither full nor old nor closed stay in its state until it goes on.
    """
    most = count if most is None else most
    span = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, opened, dropped = state.get if state.exists else ([], None, 0)
        ids, out = list(ids), []

        def let_go(reason):
            nonlocal ids, opened, dropped
            out.append((key[0], pd.Timestamp(opened, unit="us"), len(ids), dropped, ids, reason))
            ids, opened, dropped = [], None, 0

        if state.hasTimedOut:
            let_go("time")
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "mark", "event_id"])
            for at, i, mark in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["mark"].tolist()):
                if opened is not None and at >= opened + span:
                    let_go("time")
                if mark:
                    if opened is not None:
                        let_go("close")
                    continue
                opened = at if opened is None else opened
                ids.append(i)
                if len(ids) > most:
                    ids, dropped = ids[1:], dropped + 1
                if len(ids) + dropped >= count:
                    let_go("count")
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((ids, opened, dropped))
            state.setTimeoutTimestamp(max((opened + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "opened", "n", "dropped", "ids", "reason"])

    kind = events.schema[by].dataType.simpleString()
    rows = events.where("ts is not null").withWatermark("ts", late).select(by, F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.col("event_id").isNull().alias("mark"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, opened timestamp, n long, dropped long, ids array<long>, reason string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
