"""Sessions cut at the end of their work, on a stream (W9): the rule of operators.events.session_cut with state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from changeloom.operators.events import BREAK_SECONDS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what spark.sql.streaming.stateStore.providerClass must name
EVENT = "at_us long, tie long, wrote boolean, prompt boolean, other boolean"


def kept(events: list[tuple[int, int, bool, bool, bool]]) -> int:
    """How many of a session's events (microseconds, tie, wrote, prompt, wrote elsewhere), sorted, come before its end; 0 without a write."""
    last = max((i for i, e in enumerate(events) if e[2]), default=None)
    if last is None:
        return 0
    asked = None
    for i in range(last + 1, len(events)):
        at, _, _, prompt, other = events[i]
        if prompt:
            if (at - events[i - 1][0]) // 1_000_000 > BREAK_SECONDS:
                return i
            asked = i
        elif other:
            return i if asked is None else asked
    return len(events)


class _Cut(StatefulProcessor):
    """Keeps a session's events in any order of arrival; when the watermark has passed the last one by `idle`, the session is cut and its events go out."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.end = handle.getValueState("end", "at_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = self.end.get()[0] if self.end.exists() else None
        latest = end
        for frame in rows:
            us = frame["at"].astype("datetime64[us]").astype("int64")
            new = list(zip(us.tolist(), frame["tie"].tolist(), *(frame[c].fillna(False).astype(bool).tolist() for c in ("wrote", "prompt", "other")), strict=True))
            if new:
                self.events.appendList(new)
                top = max(e[0] for e in new) // 1000
                latest = top if latest is None else max(latest, top)
        if latest is not None and latest != end:
            if end is not None:
                self.handle.deleteTimer(end + self.idle_ms)
            self.end.update((latest,))
            self.handle.registerTimer(latest + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        events = sorted(tuple(e) for e in self.events.get())
        keep = events[: kept(events)]
        self.events.clear()
        self.end.clear()
        if keep:
            yield pd.DataFrame({"session": [key[0]] * len(keep), "at": pd.to_datetime([e[0] for e in keep], unit="us"), "tie": [e[1] for e in keep]})

    def close(self) -> None:
        pass


def cut_sessions(events: DataFrame, late: str = "1 hour", idle_seconds: int = 24 * 3600) -> DataFrame:
    """session, at, tie of a stream of events (session, at: timestamp, tie: long, wrote, prompt, other: booleans), of each session up to its end.

    A session goes out when the watermark, `late` behind the latest event, has passed its last event by idle_seconds; what comes for it
    after that begins a new one. Until then its events may come in any order, as long as they are not later than the watermark; the result is
    that of the batch operator. Sessions without a write give nothing, null flags are false, rows without a session or a time are left
    out. State is held by session in the state store (PROVIDER must be set), so a lost executor's sessions are read again from the checkpoint.
    """
    rows = events.select("session", "at", "tie", "wrote", "prompt", "other").where("session IS NOT NULL AND at IS NOT NULL AND tie IS NOT NULL").withWatermark("at", late)
    kind = events.schema["session"].dataType.simpleString()
    return rows.groupBy("session").transformWithStateInPandas(_Cut(idle_seconds * 1000), f"session {kind}, at timestamp, tie long", "Append", "EventTime")
